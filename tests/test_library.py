"""Rules against hand-made vectors, segmentation against a sequential version, queries against DuckDB."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomlight.functions.rules import BOUNDARY, STORY, columns
from loomlight.operators import grouped, logs
from loomlight.plans import registry

DATA = "/root/testdata/sf0.001"
RULES = columns()


@pytest.mark.parametrize(
    "rule, text, want",
    [
        ("normalize", "GET /a 200 in 999ms", "GET /a NUMBER in (fast)"),
        ("normalize", "GET /a 200 in 20500ms", "GET /a NUMBER in (CRITICAL >20s)"),
        ("normalize", "1.1.1.1 2.2.2.2", "IP NUMBER.NUMBER.NUMBER.NUMBER"),
        ("normalize", "2024-01-01T00:00:00Z TypeError: x user: bob 42", "TIMESTAMP ERROR: x user=USER NUMBER"),
        ("normalize", "a@b.co pid=7 token=abc", "EMAIL pid=ID token={TOKEN}"),
        ("line_score", "GET /a 200 in 999ms", -2),
        ("line_score", "GET /a 200 in 20500ms", 3),
        ("placeholders", "tenantId=ab-12&x", "tenant{ID}&x"),
        ("error_hash", "error: x", "n36rd6"),
        ("category", "2. click login", "Authentication"),
        ("category", "2. click here", "Story"),
    ],
)
def test_rules(spark, rule, text, want):
    got = spark.createDataFrame([(text,)], "line string").select(RULES[rule]("line")).first()[0]
    assert got == want


def sequential(lines):
    """Sizes of the events of a text, line by line; blank lines open events but don't count."""
    events, current = [], []
    for i, line in enumerate(lines):
        t = line.strip()
        if i and current and (not t or re.search(STORY, t) or any(re.search(p, t) for p in BOUNDARY)):
            events.append(current)
            current = []
        current.append(line)
    events.append(current)
    return [n for n in (sum(bool(x.strip()) and not re.search("(?i)heartbeat|healthcheck|debug", x) for x in e) for e in events) if n]


def test_segmentation(spark):
    spark.read.parquet(f"{DATA}/events.parquet").createOrReplaceTempView("events")
    from loomlight.sources.logs import LINES

    lines = spark.sql(LINES).where("doc_id < 12").orderBy("doc_id", "line_no").collect()
    got = {}
    for r in registry.queries()["events_segment"](spark, DATA).where("doc_id < 12").orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append(r["n_lines"])
    for d in {r["doc_id"] for r in lines}:
        assert got[d] == sequential([r["line"] for r in lines if r["doc_id"] == d])


@pytest.mark.parametrize(
    "line, want",
    [
        ("x" * 240, "x" * 240),
        ("x" * 300, "x" * 120 + " … " + "x" * 120),
        ("GET /a/b 500 in " + "y" * 300, "GET /a/b 500 … " + "y" * 111),
        ("at src/core/a.ts:12 " + "z" * 300, "src/core/a.ts:12 … " + "z" * 109),
        ("q" * 100 + " Error: bad" + "w" * 200, "q" * 100 + " Error: bad" + "w" * 16 + " … " + "w" * 54),
    ],
)
def test_long_lines_keep_both_ends(spark, line, want):
    from loomlight.functions.dialect import SPARK
    from loomlight.operators.render import shortened

    spark.createDataFrame([(line,)], "line string").createOrReplaceTempView("long_lines")
    steps = shortened(SPARK, "long_lines", "1 as one", "line", "short")
    assert spark.sql(logs.query(*steps, ("", "select short from long_lines_c"))).first()[0] == want


def test_structural_similarity(spark):
    """Classes against each other by the reference's steps, text by text."""
    from loomlight.operators.structure import PARTS, PATTERNS

    def parts(t):
        found = [p for p in PATTERNS if re.search(p[1], t)]
        shape = t
        for p, to in PARTS:
            shape = re.sub(p, to, shape)
        return [p[0] for p in found if p[3] == 1], {p[2] for p in found}, shape, [e for e in re.split(r"[^a-zA-Z0-9{}_-]", shape) if "{" in e]

    def similarity(a, b):
        (la, ka, sa, ea), (lb, kb, sb, eb) = parts(a), parts(b)
        if set(la) & set(lb):
            return 0.9 + 0.05 * len(set(la) & set(lb))
        if ka & kb:
            return 0.7 + 0.1 * len(ka & kb)
        if sa == sb:
            return 0.8
        return len([e for e in ea if e in eb]) / max(len(ea), len(eb)) * 0.6 if max(len(ea), len(eb)) else 0.0

    spark.read.parquet(f"{DATA}/events.parquet").createOrReplaceTempView("events")
    from loomlight.sources.logs import LINES

    text = {r["doc_id"] * 1000000 + r["line_no"]: r["line"] for r in spark.sql(LINES).collect()}
    rows = registry.queries()["struct_similarity"](spark, DATA).collect()
    assert len(rows) > 20
    for r in rows:
        assert abs(r["similarity"] - similarity(text[r["a"]], text[r["b"]])) < 1e-5


def test_kernels():
    assert grouped.levenshtein("kitten", "sitting", 9) == 3
    assert grouped.greedy([("X X", "A"), ("X X", "B"), ("X Y", "A")], 0.0084, 0.8) == [0, 0, 1]


def test_streaming(spark):
    from loomlight.streaming.live import category_counts

    rows = spark.createDataFrame([("GET /a 500 in 9ms",), ("healthcheck ok",), ("login denied",)], "line string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r["category"]: r["n"] for r in category_counts(rows).collect()}
    assert got == {"Other": 1, "Authentication": 1}


QUICK = ["lines_normalize", "line_score", "events_score", "clusters_exact", "error_summary_topk", "turns_segment", "turn_tfidf", "digest_files", "recap_timeline", "lsh_candidates", "sim_weighted_jaccard", "chat_json_parse", "render_document", "render_recap_output", "render_digest_document", "struct_similarity", "lines_truncate"]


@pytest.mark.parametrize("name", QUICK)
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    mine = registry.queries()[name](spark, DATA).toPandas()
    other = c.sql(registry.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(mine) == rows(other)


ODD_TEXTS = [
    (1, "GET /api/v1 get App.js main.py 404 1234 Error x.log.md foo(bar) F(a.b) the zz zz zz"),
    (1, "x.js get get -- .. _ a-b () 550e8400-e29b-41d4-a716-446655440000"),
    (2, "İx aİ.js \u212a\u212a éa 日本 the and of SELECT select"),
    (3, None),
    (4, ""),
    (4, "the and"),
    (5, "alone"),
    (None, "no id get 200"),
    (6, "y" * 5000 + " .md a.md " + "zz yy " * 700 + "App.js"),
    *((i, " ".join(f"w{j % (i + 3)}" + ".js" * (j % 5 == 0) for j in range(i))) for i in range(7, 60)),
]


def test_technical_tokens():
    """Two compiled patterns say what the list of patterns says."""
    from loomlight.operators.text import TECHNICAL
    from loomlight.operators.weighted import END, WHOLE, factors, technical

    every = lambda t: any(re.search(p, t) for p in TECHNICAL)
    assert (WHOLE.pattern + END.pattern).count(b"(?i:") + (WHOLE.pattern + END.pattern).count(b"(?:^") == len(TECHNICAL)
    for t in "GET gets get 200 2000 20 Failed 550E8400-e29b-41d4-a716-446655440000 a.JS a.js.b .md .mdx md f(x) f( (x) /a/B /a.b / select selects a/get get/a x.py/ a.b.py 1.c".split():
        assert technical(t.encode()) == every(t), t
        low = t.lower()
        assert factors(low.encode()) == ((3 if every(low) else 1) * (2 if re.search(r"^\d{3}$", low) else 1), (3 if every("a " + low) else 1) * 1.5), t


@pytest.mark.parametrize("name", ["token_weights", "token_stats"])
@pytest.mark.parametrize("block, rows_at_once", [(None, 10000), (1, 1), (300, 2)])
def test_token_sums_of_odd_texts(spark, tmp_path, monkeypatch, name, block, rows_at_once):
    """Equal to the SQL for repeated and missing ids, whatever the blocks; texts are shuffled once, tokens never."""
    from loomlight.operators import weighted

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").repartition(3).write.parquet(path)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(rows_at_once))
    try:
        got = registry.queries()[name](spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Generate" not in plan and "Join" not in plan
        mine = got.toPandas()
    finally:
        spark.conf.set(limit, before)
    if block:
        monkeypatch.setattr(weighted, "BLOCK", block)
        monkeypatch.setattr(weighted, "ROWS", 3)
        batches = spark.read.parquet(path).where("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') as text", "lower(replace(coalesce(text, ''), 'İ', 'i')) as lowered").orderBy("doc_id").toArrow().to_batches(rows_at_once)
        sums = {}
        for ids, b in weighted.whole(batches):
            for doc, token, weight in b.weights():
                assert len(token) <= 3
                for d, t, w in zip(ids.take(doc).to_pylist(), token.to_pylist(), weight):
                    assert (d, t) not in sums
                    sums[d, t] = w
        if name == "token_weights":
            assert sums == pytest.approx({(r.doc_id, r.token): r.weight for r in mine.itertuples()}, abs=1e-6)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/*.parquet'")
    other = c.sql(registry.oracle_sql()[name]).df()
    assert len(other) > 5
    rows = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else v for v in r) for r in df[list(other.columns)].itertuples(index=False))
    assert rows(mine) == rows(other)
    assert list(mine.columns) == list(other.columns)


def test_entry_imports_without_llm():
    source = Path(logs.__file__).parent.parent
    for p in source.rglob("*.py"):
        if "llm" not in p.relative_to(source).parts:
            assert "llm" not in p.read_text(), p
