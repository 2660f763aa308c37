"""Palettes from JSON and from the cache."""

import pytest

from weftline.sources.palette_cache import cache_text, load_palette, parse_cache, parse_palette_json


def test_json():
    assert parse_palette_json('{"name": "Two", "colors": ["#ff0000", "00FF00"]}', "two") == ("Two", [(255, 0, 0), (0, 255, 0)])
    assert parse_palette_json('{"colors": ["000000"]}', "one")[0] == "one"
    for bad in ('{"colors": []}', '{"colors": [1]}', '{"name": "x"}', "[]", '{"colors": ["00"]}'):
        with pytest.raises(ValueError):
            parse_palette_json(bad, "bad")


def test_cache_text_round_trip():
    assert parse_cache(cache_text("Two", [(255, 0, 0), (1, 2, 3)]), "two") == ("Two", [(255, 0, 0), (1, 2, 3)])
    assert parse_cache("zz\n00FF00\n", "s") == ("s", [(0, 255, 0)])
    assert parse_cache("; name: empty\n", "s") is None


def test_cache_comes_first(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "P", "colors": ["0000FF"]}')
    first = load_palette(spark, "p", str(tmp_path / "cache"), str(tmp_path / "p.json")).first()
    (tmp_path / "p.json").unlink()
    again = load_palette(spark, "p", str(tmp_path / "cache"), str(tmp_path / "p.json")).first()
    assert first == again and (first.slug, first.b) == ("p", 255)
    with pytest.raises(ValueError):
        load_palette(spark, "../p", str(tmp_path), "")
