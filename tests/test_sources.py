"""Scans and sinks on files written by the test."""

import gzip
import json
import struct

import numpy as np
import pytest

from voxelmeter.operators import integrity
from voxelmeter.session import scratch_path
from voxelmeter.sources import census, markdown, sinks, volumes


def nifti(array, order="<", slope=1.0, inter=0.0):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, array.ndim, *array.shape, *([1] * (7 - array.ndim)))
    struct.pack_into(order + "2h", head, 70, 4, 16)
    struct.pack_into(order + "3f", head, 108, 352.0, slope, inter)
    struct.pack_into(order + "2h", head, 252, 0, 1)
    struct.pack_into(order + "12f", head, 280, -0.7, 0, 0, 10, 0, 0.7, 0, -5, 0, 0, 2.0, 1)
    head[344:348] = b"n+1\0"
    return bytes(head) + array.astype(order + "i2").tobytes(order="F")


def test_volume_scan(spark, tmp_path):
    rng = np.random.default_rng(0)
    flat = rng.integers(0, 3, (5, 4, 3))
    four = rng.integers(0, 2, (2, 5, 4, 3))
    (tmp_path / "one.nii").write_bytes(nifti(flat, slope=2.0, inter=1.0))
    (tmp_path / "two.nii.gz").write_bytes(gzip.compress(nifti(four, order=">")))
    head, vox = volumes.read_volumes(spark, str(tmp_path))
    got = {(r.case_id, r.channel, r.i, r.j, r.k): r.value for r in vox.collect()}
    want = {("one", 0, *map(int, p)): flat[tuple(p)] * 2.0 + 1.0 for p in np.argwhere(flat)}
    want.update({("two", *map(int, p)): 1.0 for p in np.argwhere(four)})
    assert got == want
    h = {r.case_id: r for r in head.collect()}
    assert h["one"]["shape"] == [5, 4, 3] and h["one"].axis_codes == "LAS" and h["two"].dtype == "i2"
    assert h["one"].spacing == pytest.approx([0.7, 0.7, 2.0])


def case(name, ids, bad=False):
    keys = [str(i) for i in ids]
    return {"name": name, "findings": {k: f"text {k}" for k in keys}, "categories": {k: "2a" for k in keys[:-1] if bad} or {k: "2a" for k in keys},
            "pixels": {k: 5 for k in keys}, "entity_counts": {k: 1 for k in keys}}


def test_census_document(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"train": [case("a", [10, 2, 1])], "val": [case("b", [0])], "test": []}))
    rows = census.read_census(spark, str(path)).collect()
    assert [(r.finding_id, r.channel) for r in sorted(rows, key=lambda r: r.finding_id) if r.case_id == "a"] == [(1, 0), (2, 1), (10, 2)]
    path.write_text(json.dumps({"train": [case("a", [1, 2], bad=True)], "val": [], "test": []}))
    with pytest.raises(Exception, match="finding ids differ"):
        census.read_census(spark, str(path)).collect()


def test_eval_document(spark, tmp_path):
    body = {"summary": {"mean_global_dice_per_finding": 0.5, "hit_rate": 1.0, "total_hits": 1, "total_findings": 1, "total_cases": 1},
            "cases": [{"file": "x", "findings": {"finding_3": {"global_dice": 0.5, "global_hit": True}}}]}
    (tmp_path / "m1.json").write_text(json.dumps(body, indent=1))
    assert [tuple(r) for r in census.read_evals(spark, str(tmp_path)).collect()] == [("m1", "x", 3, 0.5, True)]
    assert census.read_eval_summaries(spark, str(tmp_path)).first()["total_hits"] == 1


def test_scores_must_be_finite(spark):
    df = spark.createDataFrame([("m", 1, 0, 0, 0, [1.0, float("nan")])], "candidate_id string, case_id int, finding_id int, chunk int, offset int, values array<float>")
    with pytest.raises(Exception, match="non-finite"):
        census.explode_chunks(df).collect()


def _markdown(spark, *pages, **options):
    df = spark.createDataFrame([(n, "https://site.test/base/", x) for n, x in enumerate(pages)], "page_id int, url string, html string")
    return [r.markdown for r in markdown.pages_to_markdown(df, **options).orderBy("page_id").collect()]


def test_pages(spark):
    html = ("<html><head><title>x</title></head><body><script>var a = '<p>';</script><h1>Top</h1><p>One &amp; <b>two</b><br>three</p>"
            "<h2 class='c'>Part A</h2><ul><li>first</li><li><a href='/u'>link</a></li></ul><h3>Deeper</h3><p>more</p><h2>Rest</h2><p>end</p></body></html>")
    part = "## Part A\n\n- first\n- [link](https://site.test/u)\n\n### Deeper\n\nmore"
    assert _markdown(spark, html, None, "", "a < b") == [f"# Top\n\nOne & **two**\nthree\n\n{part}\n\n## Rest\n\nend", None, "", "a < b"]
    assert _markdown(spark, html, None, "", heading="PART") == [part, None, None]
    assert _markdown(spark, html, heading="absent") == [None]


def test_page_structures(spark):
    table = "<table><tr><th>Model<th>Score</tr><tr><td>A|B</td><td>0.5<br>low</td></tr><tr><td>one</table>"
    lists = "<ol start='3'><li>x<ul><li>y<li>z</ul></li><li>w</ol>"
    code = "<pre><code class='language-python'>if a &lt; b:\n    go()  # ok\n</code></pre><p>and <code>a `b`</code></p>"
    forms = "<form><input placeholder='Name'><input type=hidden name=h><button>Go</button><button></button><select name=s><option>p<option>q</select></form>"
    got = _markdown(spark, table, lists, code, forms, "<blockquote><p>a</p><p>b</p></blockquote><hr><img src='i.png' alt='pic'>",
                    "<p><b>open<br><p>next <a href='javascript:x()'>run</a> <a href='q'></a>", "<p>kept</p><a hre", "<div><div><h2>In</h2></div><p>text</p></div><h2>Out</h2>")
    assert got == [
        "| Model | Score |\n| --- | --- |\n| A\\|B | 0.5 low |\n| one |  |", "3. x\n   - y\n   - z\n4. w",
        "```python\nif a < b:\n    go()  # ok\n```\n\nand ``a `b```", "[Input: Name][Button: Go][Select: s: p, q]", "> a\n>\n> b\n\n---\n\n![pic](https://site.test/base/i.png)",
        "**open**\n\nnext run [https://site.test/base/q](https://site.test/base/q)", "kept", "## In\n\ntext\n\n## Out"]


def test_page_selector(spark):
    html = "<nav>menu</nav><div id='m' class='a b'><div>one</div><pre># no heading\n</pre></div><div class='a'>two</div>"
    assert _markdown(spark, html, "<p>all</p>", selector="div#m.b") == ["one\n\n```\n# no heading\n```", "all"]
    assert _markdown(spark, html, heading="no") == [None]
    with pytest.raises(ValueError, match="selector"):
        _markdown(spark, html, selector="div > p")


def test_long_page(spark):
    html = "<ul>" + "<li>x" * 20000 + "</ul>" + "<div>" * 20000 + "y"
    assert _markdown(spark, html) == ["- x\n" * 19999 + "- x\n\ny"]


def test_write_once_and_cache(spark):
    path = scratch_path(spark, "t")
    a = spark.range(10).selectExpr("id", "id % 3 as g")
    assert sinks.write_immutable(a, path) == "written"
    assert sinks.write_immutable(a.orderBy(a.id.desc()), path) == "unchanged"
    with pytest.raises(sinks.ContentConflict):
        sinks.write_immutable(a.limit(9), path)
    calls = []

    def build():
        calls.append(1)
        return a

    key = sinks.recipe_key(spark, "r", a)
    root = scratch_path(spark, "c")
    assert sinks.cached(build, key, root, spark).count() == 10 and sinks.cached(build, key, root, spark).count() == 10
    assert len(calls) == 1
    with pytest.raises(sinks.ContentConflict):
        sinks.cached(lambda: a.limit(3), key, root, spark, verify=True)


def test_overwrite_that_dies_keeps_the_former_result(spark, monkeypatch):
    path = scratch_path(spark, "imm")
    a, b = spark.range(10), spark.range(5)
    sinks.write_immutable(a, path)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *x, **y: (_ for _ in ()).throw(RuntimeError("killed between data and pointer")))
    with pytest.raises(RuntimeError):
        sinks.write_immutable(b, path, overwrite=True)
    monkeypatch.undo()
    assert sinks.read_immutable(spark, path).count() == 10
    assert sinks.write_immutable(a, path) == "unchanged"
    assert sinks.write_immutable(b, path, overwrite=True) == "replaced" and sinks.read_immutable(spark, path).count() == 5


def test_fingerprint_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    mark = lambda df: integrity.fingerprint(df).first()["fingerprint"]
    assert mark(a) == mark(a.select("s", "i").repartition(3)) != mark(a.union(a.limit(1)))


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    before = spark.createDataFrame(integrity.manifest(spark, str(tmp_path)).collect(), "path string, bytes bigint, sha256 string")
    (tmp_path / "b.txt").write_text("tw0")
    (tmp_path / "d" / "a.txt").write_text("longer")
    (tmp_path / "c.txt").write_text("new")
    got = {r.path: r.status for r in integrity.manifest_diff(before, integrity.manifest(spark, str(tmp_path))).collect()}
    assert got == {"b.txt": "hash_mismatch", "d/a.txt": "size_mismatch", "c.txt": "unexpected"}


def test_events_gap(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps({"event_index": i}) for i in (0, 1, 3)))
    _, check = census.read_events(spark, str(tmp_path), "event_index bigint")
    assert check.first()["dense"] is False


def test_score_arrays(spark, tmp_path):
    from voxelmeter.sources.score_arrays import array_shapes, read_score_arrays
    rng = np.random.default_rng(4)
    held = {}
    for candidate in ("a", "b"):
        for case in ("x", "y"):
            held[candidate, case] = rng.random((2, 5, 4, 3)).astype(np.float16 if candidate == "a" else np.float64)
            folder = tmp_path / candidate / "cases"
            folder.mkdir(parents=True, exist_ok=True)
            np.save(folder / f"{case}.npy", held[candidate, case])
    (tmp_path / "a" / "notes.txt").write_text("no array")
    for size in (64 << 20, 150):  # all files in one partition, and files in several ranges
        rows = read_score_arrays(spark, str(tmp_path), chunk=17, slice_bytes=size)
        got = rows.collect()
        assert len(got) == 4 * 2 * 4 and {(r.candidate_id, r.case_id, r.finding_id, r.chunk) for r in got} == {(c, x, f, n) for c, x in held for f in range(2) for n in range(4)}
        for r in got:
            want = held[r.candidate_id, r.case_id][r.finding_id].ravel()[r.offset:r.offset + 17].astype(np.float32)
            assert r["values"] == want.tolist() and list(r["shape"]) == [5, 4, 3] and r.offset == 17 * r.chunk
    assert all((r.candidates, r.voxels, r.ok) == (2, 60, True) for r in array_shapes(rows).collect())
    assert {r.candidate_id for r in read_score_arrays(spark, f"file://{tmp_path}", ["b"]).collect()} == {"b"}
    np.save(tmp_path / "b" / "cases" / "y.npy", np.zeros((2, 5, 4, 2)))
    assert {(r.case_id, r.ok) for r in array_shapes(read_score_arrays(spark, str(tmp_path))).collect()} == {("x", True), ("y", False)}
    whole = (tmp_path / "a" / "cases" / "x.npy").read_bytes()
    for bad, why in ((whole[:-2], "do not hold"), (None, "non-finite")):
        if bad is None:
            held["a", "x"][1, 2, 2, 2] = np.inf
            np.save(tmp_path / "a" / "cases" / "x.npy", held["a", "x"])
        else:
            (tmp_path / "a" / "cases" / "x.npy").write_bytes(bad)
        with pytest.raises(Exception, match=why):
            read_score_arrays(spark, str(tmp_path), ["a"]).collect()


def test_a_reference_without_its_semicolon_is_text():
    blocks = markdown.page_blocks('<h1>a&amp;&amp</h1><p>b &ampx; &copy; &#65; &#66 & &; c <a href="/x?a=1&amp;b=2&copy=3">d</a></p>', "http://e.org")
    assert [b["text"] for b in blocks] == ["# a&&amp", "b &ampx; © A &#66 & &; c [d](http://e.org/x?a=1&b=2&copy=3)"]


def test_copies_are_judged_by_one_reading_of_their_rows(spark):
    import random

    from pyspark.sql import functions as F
    drawn = F.udf(lambda n: random.SystemRandom().random(), "double").asNondeterministic()
    rows = spark.range(5).select("id", drawn("id").alias("dice")).withColumn("path", F.explode(F.array(F.lit("a"), F.lit("b"))))
    out = integrity.dedup_candidates(rows, F.col("id"), F.col("dice").cast("string"), ["path"], F.lit(True))
    assert sorted((r.path, r.status) for r in out.collect()) == [("a", "canonical")] * 5 + [("b", "duplicate")] * 5
