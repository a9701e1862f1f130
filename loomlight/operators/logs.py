"""Log lines, events, clusters and summaries, each as one query over `events`.

Every query is a list of named steps, the last of which is its result. Windows
and groups are keyed by doc_id (and event or cluster), so documents spread out.
"""

from __future__ import annotations

from ..functions import rules as r
from ..sources.logs import LINES


def query(*steps: tuple[str, str]) -> str:
    *named, (_, last) = steps
    return ("with " + ",\n".join(f"{n} as ({s})" for n, s in named) + "\n" + last) if named else last


class staged:
    """A query as steps and as one text. CUTS: the steps that several others read, which Spark writes once."""

    CUTS: tuple[str, ...] = ()

    def __init__(self, *more, select):
        self.more, self.select = more, select

    def steps(self, d):
        return [*(s for m in self.more for s in m(d)), ("", self.select(d) if callable(self.select) else self.select)]

    def __call__(self, d):
        return query(*self.steps(d))


def lines(d):
    return ("l", LINES)


def marked(d):
    """Lines with their event and their fate."""
    return (
        ("b", f"select doc_id, line_no, line, case when line_no > 0 and {r.boundary(d, 'line')} then 1 else 0 end as starts, ({r.noise(d, 'line')} or {r.trim(d, 'line')} = '') as dropped from l"),
        ("g", "select doc_id, line_no, line, dropped, sum(starts) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as seg from b"),
        ("k0", f"select doc_id, line_no, seg, {r.redact(d, 'line')} as line from g where not dropped"),
        ("k", "select doc_id, line_no, line, cast(dense_rank() over (partition by doc_id order by seg) - 1 as bigint) as ord from k0"),
    )


def folded(d):
    """Lines of events with long runs of stack frames folded."""
    first = d.sub(d.sub(r.trim(d, d.sub("nl", r"\s+", " ")), r"[0-9]+", "N"), r"[A-Za-z_]+", "X")
    header = d.list("concat('[STACKTRACE ', sig, '] (', cast(n as string), ' frames)')", "line")
    omitted = d.list("concat('… (', cast(n - 3 as string), ' frames omitted)')")
    isframe = d.match(r.trim(d, "line"), r.FRAME)
    return (
        ("f0", f"select doc_id, ord, line_no, line, case when {isframe} then 1 else 0 end as frame from k"),
        ("f1", "select *, row_number() over (partition by doc_id, ord order by line_no) - row_number() over (partition by doc_id, ord, frame order by line_no) as island from f0"),
        ("f2", "select *, cast(row_number() over (partition by doc_id, ord, frame, island order by line_no) as bigint) as i, cast(count(*) over (partition by doc_id, ord, frame, island) as bigint) as n from f1"),
        # only the first line of a long run is rewritten
        ("f2a", f"select *, case when frame = 1 and n > 3 and i = 1 then {r.normalize(d, 'line')} end as nl from f2"),
        ("f3", f"select *, {first} as sig from f2a"),
        ("f4", d.explode("f3", "doc_id, ord, line_no", f"case when frame = 1 and n > 3 and i = 1 then {header} when frame = 1 and n > 3 and i = 3 then {omitted} when frame = 0 or n <= 3 or i <= 2 or i = n then {d.list('line')} end", "sub", "line")),
        ("f", "select doc_id, ord, cast(row_number() over (partition by doc_id, ord order by line_no, sub) - 1 as bigint) as pos, line from f4"),
    )


def events(d):
    """(doc_id, ord, ...) of every event: lines, template, signature, score, category."""
    sizes = {"urls": (r"(?i)https?://[^\s]+", "lower(line)"), "numbers": (r"\b\d+\b", "line"), "tokens": (r"\b\w{3,}\b", "lower(line)")}
    per_line = ", ".join(f"case when not noisy then {d.findall(e, p)} end as {n}" for n, (p, e) in sizes.items())
    distinct = ", ".join(f"{d.distinct_of(n)} as n_{n}" for n in sizes)
    bonus = "case when n_urls > 1 then n_urls * 2 else 0 end + case when n_numbers > 2 then n_numbers else 0 end + case when n_tokens > 10 then cast(floor(n_tokens / 5) as bigint) else 0 end"
    # one grouping gathers all that an event needs
    return (
        ("p0", f"select *, {r.noise(d, 'line')} as noisy, {r.normalize(d, 'line')} as norm from f"),
        ("p2", f"select doc_id, ord, pos, line, case when noisy then 0 else {r.line_score(d, 'line')} end as points, {r.placeholders(d, 'line')} as template, nullif({r.structural(d, 'norm')}, '') as shape, {per_line} from p0"),
        ("p3", f"select doc_id, ord, cast(count(*) as bigint) as n_lines, cast(sum(points) as bigint) as base, {d.agg_join('line', 'chr(10)', 'pos')} as body, {d.agg_join('template', 'chr(10)', 'pos')} as template, {d.first_by('template', 'pos')} as title, {d.first_by('line', 'pos')} as example, coalesce({d.agg_join('shape', 'chr(10)', 'pos')}, '') as signature, {distinct} from p2 group by doc_id, ord"),
        ("ev", f"select doc_id, ord, n_lines, body, template, title, example, signature, base + {bonus} as score, {r.category(d, 'body')} as category, n_urls, n_numbers, n_tokens from p3"),
        ("kept", "select * from ev where case when category = 'Other' then score > 0 else score > -1 end"),
    )


def upto_events(d):
    return (lines(d), *marked(d), *folded(d), *events(d))


def context(d):
    flat = d.sub("body", r"\n", " ")
    return (
        ("s0", f"select *, {d.match(flat, r.CONTEXT)} as is_context, max(case when category = 'Story' then 1 else 0 end) over (partition by doc_id order by ord rows between unbounded preceding and current row) as inside from kept"),
        ("s1", "select *, (category = 'Story' or (inside = 1 and is_context)) as used from s0"),
    )


def clusters(d):
    """Events outside the scenario by signature; the category is the one that first held the lead."""
    return (
        ("c0", "select *, row_number() over (partition by doc_id, signature, category order by ord) as running from s1 where not used"),
        ("c1", "select *, max(running) over (partition by doc_id, signature) as top from c0"),
        ("cl", f"select doc_id, signature, cast(count(*) as bigint) as n_events, min(ord) as first_ord, {d.first_by('title', 'ord')} as title, {d.first_by('template', 'ord')} as template, {d.first_by('example', 'ord')} as example, {d.first_by('body', 'ord')} as body, {d.first_by('category', 'case when running = top then ord end')} as category, {d.collect('category', 'ord')} as categories from c1 group by doc_id, signature"),
    )


def upto_clusters(d):
    return (*upto_events(d), *context(d), *clusters(d))


def summary(d):
    """Counts by category and template over clusters that aren't benign network successes."""
    flat = d.sub("body", r"\n", " ")
    benign = "(category = 'Network' and " + d.match(flat, r"\b2\d{2}\b") + " and not " + d.match(flat, r"(?i)(error|fail|exception|aborted|timeout|denied|reset|unauthorized|not found|500|401|403|404)") + ")"
    return (
        ("u0", f"select doc_id, first_ord, title, example, categories from cl where not {benign}"),
        ("u", d.explode("u0", "doc_id, first_ord, title, example, categories", "categories", "i", "category")),
        ("u1", f"select doc_id, category, title as template, cast(count(*) as bigint) as n, min(first_ord) as first_ord, {d.first_by('example', 'first_ord')} as example from u where category <> 'Other' group by doc_id, category, title"),
        ("su", "select *, cast(row_number() over (partition by doc_id, category order by n desc, first_ord, template) as bigint) as rank, cast(count(*) over (partition by doc_id, category) as bigint) as patterns, cast(sum(n) over (partition by doc_id, category) as bigint) as total from u1"),
    )


def scenario(d):
    """The story events with their context, as one text."""
    return (
        ("t", f"select doc_id, ord, case when category = 'Story' then concat(case when ord = min(ord) over (partition by doc_id) then '' else chr(10) end, body) else concat('  ', {d.sub('body', r'\n', '\n  ')}) end as part from s1 where used"),
        ("st", f"select doc_id, concat('## Scenario Reconstruction', chr(10), {d.agg_join('part', 'chr(10)', 'ord')}) as scenario from t group by doc_id"),
    )


def error_text(d):
    """The error summary as one text."""
    return (
        ("r0", "select doc_id, category, rank, case when rank = 1 then concat('### ', category, ' (', cast(total as string), ' occurrence', case when total > 1 then 's' else '' end, ')', chr(10)) else '' end as head, concat('- \"', case when length(template) > 160 then concat(substr(template, 1, 160), '…') else template end, '\" (', cast(n as string), '×) — example: ', case when length(example) > 160 then concat(substr(example, 1, 160), '…') else example end) as row, case when rank = 5 and patterns > 5 then concat(chr(10), '- … (', cast(patterns - 5 as string), ' additional patterns)') else '' end as tail from su where rank <= 5"),
        ("es", f"select doc_id, concat('## Error Summary', chr(10), {d.agg_join('concat(head, row, tail)', 'chr(10)', 'concat(category, lpad(cast(rank as string), 3, ' + chr(39) + '0' + chr(39) + '))')}) as summary from r0 group by doc_id"),
    )


def relevant(d, e):
    flat = d.sub(e, r"\n", " ")
    code = d.find(flat, r"\b([1-5]\d{2})\b", 1)
    ms = d.find(flat, r"(?i)\b(\d{4,})ms\b", 1)
    return f"({d.match(flat, r'(?i)(error|exception|aborted|timeout|denied|reset|not found|unauthorized|forbidden|syntaxerror)')} or cast(concat('0', {code}) as double) >= 400 or cast(concat('0', {ms}) as double) >= 5000)"


def from_lines(select):
    return lambda d: query(lines(d), ("", select(d)))


def from_events(select):
    return lambda d: query(*upto_events(d), ("", select(d)))


def from_clusters(select):
    return lambda d: query(*upto_clusters(d), ("", select(d)))


def thresholds(d):
    """Largest distance and least overlap by number of events and mean signature length."""
    return "select doc_id, n_events, mean_length, case when n_events <= 50 then case when mean_length > 20 then 0.0084 else 0.0156 end when n_events < 200 then case when mean_length > 20 then 0.007 else 0.013 end else case when mean_length > 20 then 0.0028 else 0.0052 end end as max_ratio, case when n_events <= 50 then case when mean_length > 20 then 0.8316 else 1.5444 end when n_events < 200 then case when mean_length > 20 then 0.693 else 1.287 end else case when mean_length > 20 then 0.2772 else 0.5148 end end as min_jaccard from (select doc_id, cast(count(*) as bigint) as n_events, round(avg(cast(length(signature) as double)), 6) as mean_length from s1 where not used group by doc_id)"


QUERIES = {
    "lines_noise_filter": from_lines(lambda d: f"select doc_id, line_no, line from l where not {r.noise(d, 'line')}"),
    "lines_redact": from_lines(lambda d: f"select doc_id, line_no, {r.redact(d, 'line')} as line from l"),
    "lines_normalize": from_lines(lambda d: f"select doc_id, line_no, {r.normalize(d, 'line')} as line from l"),
    "lines_placeholders": from_lines(lambda d: f"select doc_id, line_no, {r.placeholders(d, 'line')} as template, {d.join(d.distinct_sorted(r.placeholder_values(d, 'line')), chr(39) + ',' + chr(39))} as ids from l"),
    "lines_latency_bucket": from_lines(lambda d: f"select doc_id, line_no, {r.latency_bucket('ms')} as bucket from (select doc_id, line_no, cast({d.find('line', r'(\d+)ms', 1)} as bigint) as ms from l where {d.match('line', r'\d+ms')})"),
    "lines_structural": from_lines(lambda d: f"select doc_id, line_no, {r.structural(d, r.normalize(d, 'line'))} as shape from l"),
    "line_score": from_lines(lambda d: f"select doc_id, line_no, {r.line_score(d, 'line')} as score from l"),
    "line_status_class": from_lines(lambda d: f"select concat(substr({r.status(d, 'line')}, 1, 1), 'xx') as class, cast(count(*) as bigint) as n from l where {r.status(d, 'line')} <> '' group by 1"),
    "line_category": from_lines(lambda d: f"select {r.category(d, 'line')} as category, cast(count(*) as bigint) as n from l group by 1"),
    "line_human_note": from_lines(lambda d: f"select doc_id, line_no, {r.human_note(d, 'line')} as is_note from l"),
    "line_boundary": from_lines(lambda d: f"select doc_id, line_no, {r.boundary(d, 'line')} as starts from l"),
    "events_segment": lambda d: query(lines(d), *marked(d), ("", f"select doc_id, ord, cast(count(*) as bigint) as n_lines, min(line_no) as first_line, {d.agg_join('line', 'chr(10)', 'line_no')} as body from k group by doc_id, ord")),
    "stack_fold": lambda d: query(lines(d), *marked(d), *folded(d), ("", "select doc_id, ord, pos, line from f")),
    "line_rle": lambda d: query(
        lines(d),
        ("n", f"select doc_id, line_no, line, {r.normalize(d, 'line')} as norm from l"),
        ("c", "select *, case when norm = lag(norm) over (partition by doc_id order by line_no) then 0 else 1 end as starts from n"),
        ("i", "select *, sum(starts) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as run from c"),
        ("", f"select doc_id, min(line_no) as first_line, cast(count(*) as bigint) as times, {d.first_by('line', 'line_no')} as line from i group by doc_id, run"),
    ),
    "events_score": from_events(lambda d: "select doc_id, ord, score, category, n_lines from ev"),
    "events_signature": from_events(lambda d: "select doc_id, ord, signature from ev"),
    "events_template_vars": lambda d: query(*upto_events(d), ("v0", d.explode("f", "doc_id, ord", r.placeholder_values(d, "line"), "i", "v")), ("v", f"select doc_id, ord, {d.agg_join('v', chr(39) + ',' + chr(39), 'v')} as ids from (select distinct doc_id, ord, v from v0) t group by doc_id, ord"), ("", "select ev.doc_id, ev.ord, template, coalesce(ids, '') as ids from ev left join v using (doc_id, ord)")),
    "events_relevant": from_events(lambda d: "select doc_id, ord, score, category from kept"),
    "events_diversity": from_events(lambda d: "select doc_id, ord, n_urls, n_numbers, n_tokens from ev"),
    "scenario_context": lambda d: query(*upto_events(d), *context(d), ("", "select doc_id, ord, category, is_context, inside = 1 as inside, used from s1")),
    "scenario_text": lambda d: query(*upto_events(d), *context(d), *scenario(d), ("", "select doc_id, scenario from st")),
    "events_unused": lambda d: query(*upto_events(d), *context(d), ("", "select kept.doc_id, kept.ord, kept.category from kept left anti join (select doc_id, ord from s1 where used) u on kept.doc_id = u.doc_id and kept.ord = u.ord" if d.name == "spark" else "select kept.doc_id, kept.ord, kept.category from kept anti join (select doc_id, ord from s1 where used) u on kept.doc_id = u.doc_id and kept.ord = u.ord")),
    "clusters_exact": from_clusters(lambda d: "select doc_id, signature, n_events, first_ord, title, category from cl"),
    "cluster_category_counts": from_clusters(lambda d: f"select doc_id, signature, category, cast(count(*) as bigint) as n from ({d.explode('cl', 'doc_id, signature, categories', 'categories', 'i', 'category')}) q group by doc_id, signature, category"),
    "cluster_topk": from_clusters(lambda d: "select doc_id, signature, n_events, first_ord, category, rank from (select *, cast(row_number() over (partition by doc_id order by n_events desc, first_ord) as bigint) as rank, case when category = 'Other' then row_number() over (partition by doc_id, category order by n_events desc, first_ord) else 0 end as other from cl) t where other <= 5 and rank <= 20"),
    "cluster_thresholds": from_clusters(thresholds),
    "unique_events": from_clusters(lambda d: f"select doc_id, first_ord, category, example, rank from (select doc_id, first_ord, category, example, cast(row_number() over (partition by doc_id order by first_ord) as bigint) as rank from cl where n_events = 1 and {relevant(d, 'body')}) t where rank <= 3"),
    "error_summary_topk": lambda d: query(*upto_clusters(d), *summary(d), ("", "select doc_id, category, template, n, rank, patterns, total from su where rank <= 5")),
    "top_templates": lambda d: query(*upto_clusters(d), *summary(d), ("v", "select category, template, cast(sum(n) as bigint) as n, cast(count(*) as bigint) as n_docs from su group by category, template"), ("", "select category, template, n, n_docs, rank from (select *, cast(row_number() over (partition by category order by n desc, template) as bigint) as rank from v) t where rank <= 5")),
    "render_compression": lambda d: query(*upto_clusters(d), *summary(d), *error_text(d), ("", "select doc_id, summary from es")),
    "compression_stats": from_clusters(lambda d: "select a.doc_id, n_events, n_clusters, chars_in, chars_kept, round(100.0 * (1 - cast(chars_kept as double) / chars_in), 6) as reduction, cast(ceil(chars_in / 4.0) as bigint) as tokens_in from (select doc_id, cast(sum(length(line) + 1) as bigint) as chars_in from l group by doc_id) a join (select doc_id, cast(sum(n_events) as bigint) as n_events, cast(count(*) as bigint) as n_clusters, cast(sum(length(title)) as bigint) as chars_kept from cl group by doc_id) b on a.doc_id = b.doc_id"),
}
