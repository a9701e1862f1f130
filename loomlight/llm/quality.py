r"""Quality rules by weak supervision, in DataFrame and SQL functions only.

Each rule looks at counts of the whole text and votes good (1), bad (-1) or
abstains (0). A latent kind explains the votes: good documents are one kind, bad
ones are of as many kinds as there are rules, each led by one rule at the start.
Expectation-maximisation estimates each kind's share and each rule's chance to
vote bad on it; the posterior probability of the good kind decides, instead of
all rules having to pass, so a single bad vote of a rule that good documents
break as well does not reject. What identifies the good kind is a beta prior on
its rules' false alarms (`false_alarm`, as heavy as `weight` times the number of
documents); nothing else bounds the estimates. Only the counts of the vote
patterns (at most 3 ** rules rows) enter, in one SQL fold over one row.

Defined results: null and wordless texts have zero counts, fail the base rule
and get the posterior of their votes; an empty table gives no rows and the prior
model; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import written

#: White space between words, and the symbols that are counted.
SPACE = r"[\\x20\\x09-\\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts; `bad` is asked first, neither is an abstention."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 40", "n_words >= 50"),
    Rule("repeats", "10 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words and n_words >= 20"),
    Rule("symbols", "20 * n_symbols > n_words", "100 * n_symbols <= n_words and n_words >= 20"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 4 * n_words and 8 * n_words and n_words >= 20"),
    Rule("dup_lines", "5 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines >= 2"),
    Rule("capitals", "5 * n_upper > word_chars", "20 * n_upper <= word_chars and n_words >= 20"),
    Rule("stops", "n_words >= 30 and 60 * n_sentence_ends < n_words or n_words >= 20 and 4 * n_sentence_ends > n_words", "40 * n_sentence_ends >= n_words and 5 * n_sentence_ends <= n_words and n_words >= 20"),
    Rule("exclaims", "2 * n_exclaims > n_sentence_ends", "10 * n_exclaims <= n_sentence_ends and n_words >= 20"),
)


def counts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The base counts and those of the further rules, per document.

    Repeated 5-word windows: hashes of the windows with their places are sorted,
    places with an equal neighbour are sorted again, and the words they cover are summed."""
    d = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.expr(f"filter(split(t, '{SPACE}+'), x -> x <> '')").alias("w"), F.expr(f"filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"))
    d = d.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    d = d.withColumn("v", F.expr("transform(if(size(h) < 5, cast(array() as array<int>), sequence(0, size(h) - 5)), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"))
    # most texts repeat no window, so the sort is for the others only
    d = d.withColumn("windows", F.expr("if(size(array_distinct(v)) = size(v), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(v, (x, i) -> struct(x as h, i as i))))"))
    d = d.withColumn(
        "places",
        F.expr("sort_array(transform(filter(transform(windows, (x, k) -> struct(x.i as i, (k > 0 and x.h = windows[greatest(k - 1, 0)].h) or (k < size(windows) - 1 and x.h = windows[least(k + 1, size(windows) - 1)].h) as twice)), x -> x.twice), x -> x.i))"),
    )
    return d.select(
        "doc_id",
        F.expr("cast(size(w) as long)").alias("n_words"),
        F.expr(f"cast(length(t) - regexp_count(t, '{SPACE}') as long)").alias("word_chars"),
        F.expr(f"cast(regexp_count(t, '{SYMBOLS}') as long)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("cast(aggregate(places, struct(0 as n, -5 as last), (s, i) -> struct(s.n + least(5, i - s.last) as n, i as last)).n as long)").alias("n_repeat_words"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr(r"cast(regexp_count(t, '\\p{Lu}') as long)").alias("n_upper"),
        F.expr(r"cast(regexp_count(t, '[.?!]') as long)").alias("n_sentence_ends"),
        F.expr(r"cast(regexp_count(t, '!') as long)").alias("n_exclaims"),
    )


def _vote(r: Rule) -> str:
    return f"case when {r.bad} then -1 when {r.good} then 1 else 0 end"


def label_model(patterns: DataFrame, n_rules: int, rounds: int = 60, share: float = 0.85, false_alarm: float = 0.02, weight: float = 0.5) -> tuple[list[float], list[list[float]]]:
    """Share of each kind (good first), and for each kind and rule the chance of a bad vote, given
    that the rule votes; from vote patterns (votes array<int>, n long). Abstentions tell nothing."""
    kinds, rules = f"sequence(0, {n_rules})", f"sequence(0, {n_rules - 1})"
    with_logs = "transform({}, b -> named_struct('v', b, 'x', ln(b), 'y', ln(1 - b)))".format
    start = f"""
      named_struct('share', transform({kinds}, k -> if(k = 0, {share}D, {(1 - share) / n_rules}D)),
        'bad', transform({kinds}, k -> {with_logs(f"transform({rules}, j -> case when k = 0 then {false_alarm}D when j = k - 1 then 0.8D else 0.1D end)")}))"""
    logits = "transform(m.bad, (r, k) -> aggregate(zip_with(p.votes, r, (v, b) -> case v when 0 then 0D when -1 then b.x else b.y end), ln(m.share[k]), (s, x) -> s + x))"
    relative = f"transform(array({logits}), l -> transform(l, x -> exp(x - array_max(l))))[0]"
    # per pattern, the documents of each kind
    dealt = f"transform(ps, p -> transform(array({relative}), e -> struct(p.votes as votes, transform(e, x -> p.n * x / aggregate(e, 0D, (s, y) -> s + y)) as w))[0])"
    total = "aggregate(ws, 0D, (s, p) -> s + if({condition}, p.w[k], 0D))".format
    alarms = f"({weight}D * aggregate(ps, 0D, (s, p) -> s + p.n) + 100D)"
    step = f"""
      transform(array({dealt}), ws -> named_struct(
        'share', transform({kinds}, k -> ({total(condition="true")} + 1) / (aggregate(ps, 0D, (s, p) -> s + p.n) + {n_rules + 1})),
        'bad', transform({kinds}, k -> {with_logs(f"""transform({rules}, j ->
          ({total(condition="p.votes[j] = -1")} + if(k = 0, {false_alarm} * {alarms}, 1D)) / ({total(condition="p.votes[j] <> 0")} + if(k = 0, {alarms}, 2D)))""")})))[0]"""
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("ps")).select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> {step})").alias("m")).first()
    return list(row["m"]["share"]), [[b["v"] for b in kind] for kind in row["m"]["bad"]]


def posterior(share: list[float], bad: list[list[float]]) -> str:
    """SQL for the chance of the good kind, given `votes`."""
    against = []
    for s, b in zip(share[1:], bad[1:]):
        votes = (f"case votes[{j}] when -1 then {math.log(x / g)!r}D when 1 then {math.log((1 - x) / (1 - g))!r}D else 0D end" for j, (x, g) in enumerate(zip(b, bad[0])))
        against.append(f"exp(least(500D, {math.log(s / share[0])!r}D + {' + '.join(votes)}))")
    return f"1 / (1 + {' + '.join(against)})"


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Base counts, base_failed, the posterior of good, and kept."""
    got = written(counts(documents, doc_id, text).withColumn("votes", F.expr("array(" + ", ".join(_vote(r) for r in rules) + ")")), "counts")
    model = label_model(got.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), len(rules))
    return got.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
        F.expr(posterior(*model)).alias("posterior"),
    ).select("*", F.expr(f"not base_failed and posterior >= {threshold}").alias("kept"))
