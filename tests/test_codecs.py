import pytest

from kinelake.sources import codecs


def test_a_suffix_without_a_reader_is_an_error():
    assert codecs.loader(".hdf5") is codecs.loader(".h5") is codecs.load_hdf5
    with pytest.raises(ValueError, match="mp4"):
        codecs.loader(".mp4")
