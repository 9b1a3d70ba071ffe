"""The stages of the pipeline on small tables: nulls, repeated ids, empty texts and tables, other columns, and against brute force."""

import re

import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def tables(spark, tmp_path, prose):
    """A folder of labels and benchmark, and its items."""
    items = [(1, prose(30)), (2, prose(14)), (None, prose(20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), [t for _, t in items]


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_toxic_rows_go(spark, docs, prose, tables):
    bad = lambda i: i % 4 == 0
    rows = [(i, prose(30) + (" snarfulous grumblewort " if bad(i) else " ") + prose(5)) for i in range(120)] + [(None, "grumblewort snarfulous"), (None, "plain"), (3, None), (3, ""), (4, "plain"), (4, "plain")]
    got = rows_of(STAGES["toxicity"](spark, docs(rows), tables[0]))
    assert got == sorted([r for r in rows if "grumblewort" not in (r[1] or "")], key=str)


def test_one_of_each_group_stays(spark, docs, prose, tables):
    a, b = prose(60), prose(50)
    rows = [(5, a), (2, a + " more"), (9, a.upper()), (None, a), (7, b), (7, b), (7, prose(40)), (None, "x y"), (None, "x  y"), (3, None), (4, "")]
    got = rows_of(STAGES["near_duplicates"](spark, docs(rows), tables[0]))
    assert got == sorted([rows[1], rows[4], rows[6], (3, None)] + [min(rows[7:9], key=lambda r: r[1])], key=str)


def test_repeated_passages_are_cut(spark, docs, prose, tables):
    a = prose(30)
    rows = [(1, a), (2, a), (3, f"{a}\n{prose(3)}"), (4, "kept  as\tit is"), (None, a + " end"), (None, None), (6, ""), (8, prose(6)), (8, prose(6))]
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            first[tuple(w[p : p + 13])] = min(key(i), first.get(tuple(w[p : p + 13]), float("inf")))
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p + j for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < key(i) for j in range(13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        if not gone or kept:
            want.append((i, kept if gone else t))
    got = STAGES["repeated_passages"](spark, docs(rows), tables[0])
    assert rows_of(got) == sorted(want, key=str) and (2, a) not in want and got.where("doc_id = 3").first()["n_chars"] == len(want[1][1])


def test_contaminated_rows_go(spark, docs, prose, tables):
    folder, items = tables
    rows = [(1, f"{prose(9)} {items[0]} {prose(9)}"), (None, items[1].upper()), (None, prose(9)), (2, items[2]), (2, prose(12)), (3, None), (4, ""), (5, items[0][: len(items[0]) // 2])]

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = [r for r in rows if not any(len(grams(x) & grams(r[1])) >= 0.8 * len(grams(x)) for x in items)]
    assert rows_of(STAGES["decontamination"](spark, docs(rows), folder)) == sorted(want, key=str) and len(want) == 5


def test_every_row_is_packed(spark, docs, prose, tables):
    rows = [(1, prose(40)), (1, prose(40)), (None, "a"), (None, "b"), (2, None), (3, ""), (4, prose(9000))]
    got = STAGES["packing"](spark, docs(rows), tables[0]).collect()
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert sum(r["piece"] == 0 for r in got) == len(rows) and sorted(r["length"] for r in got if r["doc_id"] in (2, 3)) == [1, 1]


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables_and_other_columns(spark, docs, prose, tables, name):
    assert STAGES[name](spark, docs([]), tables[0]).count() == 0
    rows = docs([(i, prose(20)) for i in range(6)])
    for c in ("score", "h", "kept_text", "n_removed", "mf_batch", "w1", "component_id", "th", "item_id", "piece", "length", "sequence_id"):
        rows = rows.selectExpr("*", f"'clash' as {c}")
    got = STAGES[name](spark, rows, tables[0])
    assert got.select("doc_id").distinct().count() == 6 and (name == "packing" or got.columns == corpus_pipeline.COLUMNS)


def test_stages_without_labels_or_items(spark, docs, prose, tmp_path):
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = [(i, prose(20)) for i in range(4)]
    for name in ("toxicity", "decontamination"):
        assert rows_of(STAGES[name](spark, docs(rows), str(tmp_path))) == sorted(rows, key=str)
