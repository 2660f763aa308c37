"""Repeated ids with different texts, ids of other types, and base columns and segmentations against plain versions."""

import math
import random

import duckdb
import pytest

from weftline.llm import order_minhash, quality, secrets

rng = random.Random(8)
WORDS = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
A, B, C, D = (" ".join(rng.choices(WORDS, k=60)) for _ in range(4))
DDL = "doc_id long, text string, source string, class_id string"


def classes(spark, rows):
    df = spark.createDataFrame([(*r, "s", "clash") for r in rows], DDL)
    found = sorted((r.doc_id, r.class_id, r.kept) for r in order_minhash.near_duplicates(df).collect())
    kept = sorted(((r.doc_id, r.text) for r in order_minhash.drop_near_duplicates(df).collect()), key=str)
    return found, kept


def test_one_of_two_texts_of_an_id_is_a_duplicate(spark):
    found, kept = classes(spark, [(3, A), (5, A), (5, B), (9, C)])
    assert found == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert kept == [(3, A), (5, B), (9, C)]  # the text that has no duplicate stays


def test_texts_of_an_id_link_what_they_are_near(spark):
    rows = [(1, A), (2, B), (5, A + " x"), (5, B + " y"), (5, B + " y"), (7, C), (7, D), (8, None), (8, ""), (8, D), (4, D)]
    found, kept = classes(spark, rows)
    assert {f[:2] for f in found} == {(1, 1), (2, 1), (5, 1), (7, 4), (8, 4), (4, 4)} and len(found) == len(rows)
    assert kept == sorted([(1, A), (2, B), (7, C), (4, D), (8, None), (8, "")], key=str)


def test_rows_that_repeat_wholly(spark):
    found, kept = classes(spark, [(3, A)] * 3 + [(4, C)] * 2 + [(6, "")] * 2)
    assert {f[:2] for f in found} == {(3, 3), (4, 4), (6, 6)} and len(found) == 7
    assert kept == sorted([(3, A), (4, C), (6, "")])


@pytest.mark.parametrize(("kind", "quality_kind"), [("string", "int"), ("int", "long"), ("long", "long"), ("long", "short")])
def test_quality_with_other_types(spark, kind, quality_kind):
    texts = [" ".join(rng.choices(WORDS, k=60)) if i % 4 else "$$$ ".join(rng.choices(WORDS, k=60)) for i in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(160)], "doc_id long, quality long").selectExpr(f"cast(doc_id as {kind}) doc_id", f"cast(quality as {quality_kind}) quality")
    found = quality.quality(docs, labels)
    assert dict(found.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
    assert not any(r.kept for r in found.collect() if int(r.doc_id) % 4 == 0)


def test_short_values_are_priced():
    assert [k for *_, k in secrets.find_spans('password is "%T9&x"')] == ["guess"] and secrets.guess_cost("%T9&x")[0] >= secrets.MIN_GUESSES
    for text in ["%", "%T", "%T9", "%T9é", "%T9é&", "%T9é&x", "a", "ab1", "pass"]:
        found = secrets.find_spans(f'pwd = "{text}"')
        assert bool(found) == (secrets.guess_cost(text)[0] >= secrets.MIN_GUESSES), text


def cheapest(value):
    """Least cost over all segmentations, each span priced for itself."""
    lower, plain, brute = value.lower(), value.lower().translate(secrets._LEET), math.log10(secrets._cardinality(value))

    def prices(a, b):
        part, n = value[a:b], b - a
        yield "brute", 0.3 + n * brute
        if n > 1:
            if rank := secrets._RANK.get(lower[a:b]) or secrets._RANK.get(plain[a:b]):
                case = 0.0 if part == lower[a:b] else 0.3 if part[1:] == lower[a + 1 : b] else 1.0
                yield "word", math.log10(rank + 1) + (0.0 if lower[a:b] in secrets._RANK else 0.6) + case
        if part == " ":
            yield "space", secrets._SPACE
        if (m := secrets._DATE.match(value, a)) and m.end() == b:
            yield "date", math.log10(365 * (130 if n > 4 else 1))
        first = b - 1
        while first and secrets._adjacent(lower[first - 1], lower[first]):
            first -= 1
        if n >= 3 and first == a:
            yield "walk", math.log10(94 * n * 4)
        for unit in range(1, min(secrets.UNIT, n // 2) + 1):
            longest = unit  # only the longest repeat that ends here counts
            while longest + 1 <= b and value[b - longest - 1] == value[b - longest - 1 + unit]:
                longest += 1
            times = longest // unit
            if n == times * unit >= 3 and times >= 2:
                piece = value[b - unit : b]
                word = math.log10(secrets._RANK[piece.lower()] + 1) if piece.lower() in secrets._RANK else math.inf
                yield "repeat", min(unit * math.log10(secrets._cardinality(piece)), word) + math.log10(times)

    best = [0.0] + [math.inf] * len(value)
    for b in range(1, len(value) + 1):
        best[b] = min(best[a] + p for a in range(b) for _, p in prices(a, b))
    return best[-1]


def test_cost_against_all_segmentations():
    parts = ["password", "Monkey", "1999-12-31", "sdfghj", "zzzz", "ab", "x", "7", "Q!", "abcabc", "12", "m0nkey", " ", "é"]
    for _ in range(400):
        value = "".join(rng.choices(parts, k=rng.randint(1, 4)))
        assert abs(secrets.guess_cost(value)[0] - cheapest(value)) < 1e-9, value


def test_base_columns_against_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(rf"""SELECT doc_id,
        len(list_filter(regexp_extract_all(t, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 'i'), lambda x: length(x) >= 8)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
        len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM '{path}')""").fetchall()
    got = {tuple(r)[:4] for r in secrets.scan(spark.read.parquet(path)).collect()}
    assert got == set(rows) and sum(r[1] for r in rows) > 5


def test_quality_columns_against_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{path}'),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        three AS (SELECT doc_id, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM three QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(3) r(o) GROUP BY doc_id),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT doc_id, len(ws), coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT, len(regexp_extract_all(t, '[#*$%&|<>]')), coalesce(lines.n, 0), coalesce(covered.n, 0)
        FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)""").fetchall()
    found = quality.quality(spark.read.parquet(path), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert {tuple(r) for r in found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()} == set(rows)
