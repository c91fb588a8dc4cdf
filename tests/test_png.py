"""PNG images: all filters and channels back to their pixels; every cut and every changed byte is noticed."""

import numpy as np
import pytest

from pelagia.sources import png


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
def test_round_trip(channels, filters):
    image = np.random.default_rng(channels).integers(0, 256, (9, 7, channels)).astype(np.uint8)
    assert np.array_equal(png.decode(png.encode(image, filters)), image)


def test_gray_levels():
    image = np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 0]]], np.uint8)
    assert png.gray(image).tolist() == [[255, 76, 0]] and png.gray(image[..., :1]).tolist() == [[255, 255, 0]]


def test_cut_and_changed_files():
    data = png.encode(np.arange(60, dtype=np.uint8).reshape(6, 10, 1), [4, 2])
    for n in range(len(data)):
        with pytest.raises(png.BrokenImage):
            png.decode(data[:n])
    for i in range(len(data) - 12):
        with pytest.raises(png.BrokenImage):
            png.decode(data[:i] + bytes([data[i] ^ 4]) + data[i + 1 :])
