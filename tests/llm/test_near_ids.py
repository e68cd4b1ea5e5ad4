import random

from kinelake.llm.near_dedup import drop_near_copies, near_groups

from .conftest import prose
from .test_dedup import brute_near


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def agree(spark, rows):
    want = brute_near(rows)
    got = near_groups(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.doc_id, r.component_id, r.kept) == (r.doc_id, want[r.doc_id], want[r.doc_id] == r.doc_id)
    stay = {r.doc_id for r in drop_near_copies(table(spark, rows)).collect()}
    assert stay - {None} == {d for d, c in want.items() if c == d}


def test_an_id_with_several_texts_has_one_component(spark):
    rng = random.Random(1)
    a, b, c = (prose(rng, 60) for _ in range(3))
    agree(spark, [(3, a), (5, a), (5, b), (8, b), (9, c), (5, None), (11, " "), (11, ""), (None, a)])


def test_any_of_an_ids_sizes_may_fit(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):  # a long and a short text for each id; each is near one text of another id
        long, short = prose(rng, 400).split(), prose(rng, 60).split()
        rows += [(10 * k, " ".join(long)), (10 * k, " ".join(short)), (10 * k, prose(rng, 1500))]
        long[7], short[-1] = "changed", "changed"
        rows += [(10 * k + 1 + k % 2, " ".join(short if k % 3 else long))]
    agree(spark, rows)
