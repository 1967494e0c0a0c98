"""Trees of documents, reissues and releases."""

from pathlib import Path
from random import Random

from pyspark.sql import functions as F

from clauseloom.operators import exports, intake


def plain_tree(nodes):
    """Read the forest as it arrives: a document, then its first child with all below it."""
    below, out, seen = {}, {}, {}
    for i, parent, *_ in nodes:
        below.setdefault(parent, []).append(i)
    held = {i: (parent, name, text) for i, parent, name, text in nodes}

    def visit(i, root, depth):
        parent, name, text = held[i]
        content = text or (name if parent is not None else "")
        original = seen.setdefault(content, i)
        out[i] = (root, depth, None if original == i else original)
        if original == i:
            for child in sorted(below.get(i, [])):
                visit(child, root, depth + 1)

    for i in sorted(below.get(None, [])):
        visit(i, i, 0)
    return out


def test_tree_against_plain(spark):
    rng = Random(6)
    nodes, depth = [], {}
    for i in range(400):
        parent = rng.choice([None, None, *[j for j in range(max(0, i - 12), i) if depth[j] < 3]])
        depth[i] = 0 if parent is None else depth[parent] + 1
        nodes.append((i, parent, f"n{rng.randrange(20)}", rng.choice(["", None, *[f"text {rng.randrange(150)}" for _ in range(8)]])))
    df = spark.createDataFrame(nodes, "id long, parent_id long, name string, text string")
    got = {r.id: (r.root, r.depth, r.duplicate_of) for r in intake.recorded_tree(df).collect()}
    assert got == plain_tree(nodes)
    assert intake.recorded_tree(df.limit(0)).collect() == []


def test_reissues_of_a_hot_name(spark):
    rows = [(i, "hot" if i % 3 else f"f{i % 5}", i % 7 > 0) for i in range(0, 3_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, filename string, ok boolean")
    for width in (16, 1 << 16):
        got = {r.doc_id: (r.supersedes, r.superseded_by) for r in intake.reissues(df, eligible=F.col("ok"), width=width).collect()}
        last, want = {}, {i: [None, None] for i, *_ in rows}
        for i, name, ok in rows:
            if ok:
                if name in last:
                    want[i][0], want[last[name]][1] = last[name], i
                last[name] = i
        assert got == {i: tuple(v) for i, v in want.items()}


def test_release_is_audited_before_it_is_published(spark, tmp_path):
    sheets = {"Summary": spark.range(50).selectExpr("id", "id % 3 AS kind"), "Proposed Tests": spark.range(400).repartition(4).selectExpr("id", "concat('t', id) AS name", "if(id % 5 = 0, null, id / 7) AS score")}
    expected = {k: df.columns for k, df in sheets.items()}
    at = f"file://{tmp_path}/week-38"
    assert exports.publish_release(sheets, at, expected) == [] and spark.read.parquet(f"{at}/Summary").count() == 50
    assert exports.publish_release(sheets, at, expected) == ["the release exists already"]
    assert exports.publish_release(sheets, f"{at}-b", expected | {"LOV": ["x"], "Summary": ["id", "kind", "why"]}) == ["Summary: columns ['why']", "LOV: missing"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["week-38"]  # drafts that fail go
    assert exports.audit_release(spark, at, expected) == []
    parts = sorted(Path(f"{tmp_path}/week-38/Proposed Tests").glob("part-*.parquet"))
    saved = {p: p.read_bytes() for p in parts}
    parts[0].unlink()
    assert exports.audit_release(spark, at, expected)[0].startswith("Proposed Tests: ")
    parts[0].write_bytes(saved[parts[0]])
    for crc in Path(f"{tmp_path}/week-38/Proposed Tests").glob(".*.crc"):
        crc.unlink()
    parts[1].write_bytes(saved[parts[1]][:-40])
    assert "unreadable" in exports.audit_release(spark, at, expected)[0]
    parts[1].write_bytes(saved[parts[2]])  # a part that is there twice, in the place of another
    assert exports.audit_release(spark, at, expected)[0].startswith("Proposed Tests: ")
    parts[1].write_bytes(saved[parts[1]])
    assert exports.audit_release(spark, at, expected) == []
    held = spark.read.parquet(f"{at}/Summary").selectExpr("id", "if(id = 7, 9, kind) AS kind").collect()
    spark.createDataFrame(held, "id long, kind long").write.mode("overwrite").parquet(f"{at}/Summary")
    assert exports.audit_release(spark, at, expected) == ["Summary: rows differ"]
