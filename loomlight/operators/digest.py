"""Structured facts of a log or transcript: files, errors, plans, timeline."""

from __future__ import annotations

from ..functions import rules as r
from .logs import lines, query

# Patterns of the facts.
FILES = (
    (r"(?i)file:\s*([^\s,\n]+)", 1),
    (r"(?i)(?:src|lib|test|docs|components?|pages?|utils?|config|build)/[\w./-]+\.\w+", 0),
    (r"(?i)(?:Modified|Created|Added|Updated|Edited|Deleted|Removed|Touched).*?([^\s,\n]+\.\w+)", 1),
)
EXTENSIONS = "js cjs mjs ts tsx jsx json md mdx yml yaml toml css scss sass less html htm svelte vue py rb go rs java kt cs php sql".split()
ERROR_LINE = r"(?i)(error):\s*([^\n]+)|failed.*?([^\n]+)|exception:\s*([^\n]+)|(❌|⚠️|⛔).*?([^\n]+)"
FIXED = r"(?i)(Fixed|resolved|corrected|ajustado)"
DECISIONS = ((r"(?i)(?:will|should|must|going to|plan to|next)[\s:]([^\n]+)", 1), (r"(?i)milestone[\s:]([^\n]+)", 1), (r"(?i)decision[\s:]([^\n]+)", 1))
MILESTONES = ((r"(?i)milestone[\s:]+([^\n]+)", 1), (r"(?i)phase\s+([A-Z0-9]+)[\s:]+([^\n]+)", 1))
TIMELINE = (("action", r"(?i)(Added|Created|Modified|Updated|Refactored)"), ("error", r"(?i)(error|failed)"), ("decision", r"(?i)(will|should|next|milestone)"), ("completion", r"(?i)(✓|✅|done|completed)"))
STATUS = (("created", r"(?i)(Added|Created|new|criada)"), ("removed", r"(?i)(Deleted|Removed|removida)"), ("modified", r"(?i)(Modified|Updated|edited|atualizada)"))
ACTIONS = (("Added", r"(?i)Added.*?([^\s,\n]+)"), ("Refactored", r"(?i)refactored"), ("Fixed", r"(?i)fix"), ("Implemented", r"(?i)implemented"), ("Updated", r"(?i)updated"), ("Created", r"(?i)create"), ("Deleted", r"(?i)deleted"), ("Modified", r"(?i)modif(?:ied|y)"), ("Touched", r"(?i)touched"))


def valid_path(d, e):
    p = d.sub(r.trim(d, e), r"^\./", "")
    ext = "|".join(EXTENSIONS)
    return f"(length({e}) <= 240 and {d.match(p, rf'(?i)\.({ext})$')} and not {d.match(p, r'[|*\[\](){}]')} and ({p} like '%/%' or {d.match(p, r'^[\w-]+\.[\w-]+$')}))"


def text(d):
    return (("x", f"select doc_id, {d.agg_join('line', 'chr(10)', 'line_no')} as text from l group by doc_id"),)


def files(d):
    """Distinct paths in pattern order, then position, with the context of the first mention."""
    found = " union all ".join(f"select doc_id, {k} as pattern, pos, path from ({d.explode('x', 'doc_id', d.findall('text', p, g), 'pos', 'path')}) p{k}" for k, (p, g) in enumerate(FILES))
    near = "substr(text, cast(greatest(1, found_at - 200) as int), cast(least(200, found_at - 1) + 200 as int))"
    status = "case " + " ".join(f"when {d.match('context', p)} then '{s}'" for s, p in STATUS) + " else 'touched' end"
    actions = d.filter(d.list(*(f"case when {d.match('context', p)} then '{a}' else '' end" for a, p in ACTIONS)), "x <> ''")
    return (
        ("f0", found),
        ("f1", f"select doc_id, path, min(pattern * 1000000 + pos) as place from f0 where {valid_path(d, 'path')} group by doc_id, path"),
        ("f2", "select f1.doc_id, path, place, text, cast(instr(text, path) as bigint) as found_at from f1 join x on f1.doc_id = x.doc_id"),
        ("f3", f"select doc_id, path, place, {near} as context from f2"),
        ("fi", f"select doc_id, path, cast(row_number() over (partition by doc_id order by place) as bigint) as rank, {status} as status, {d.join(d.slice(actions, '1', '2'), chr(39) + ',' + chr(39))} as actions from f3"),
    )


def errors(d):
    return (
        ("e0", f"select doc_id, line_no, line, {r.error_normal(d, 'line')} as norm from l where {d.match('line', ERROR_LINE)}"),
        ("e1", f"select *, {r.error_hash(d, 'norm')} as signature, cast(row_number() over (partition by doc_id order by line_no) - 1 as bigint) as nth from e0"),
        ("er", f"select doc_id, signature, cast(count(*) as bigint) as frequency, min(line_no) as first_line, {d.first_by('substr(line, 1, 120)', 'line_no')} as message from e1 group by doc_id, signature"),
    )


def fixes(d):
    """The first fixing line among lines k+1..k+9 for the k-th error line."""
    return (
        ("x0", f"select doc_id, line_no, {d.find('line', r'([^\s]+\.\w+)', 1)} as path from l where {d.match('line', FIXED)}"),
        ("x1", f"select e1.doc_id, e1.signature, e1.nth, {d.first_by('path', 'x0.line_no')} as path from e1 join x0 on e1.doc_id = x0.doc_id and x0.line_no between e1.nth + 1 and e1.nth + 9 group by e1.doc_id, e1.signature, e1.nth"),
        ("fx", "select doc_id, signature, path, min(nth) as first_nth from x1 where path <> '' group by doc_id, signature, path"),
    )


def _found(d, patterns, src="l", e="line"):
    return " union all ".join(f"select doc_id, line_no, {k} as pattern, pos, {r.trim(d, 'v')} as v from ({d.explode(src, 'doc_id, line_no', d.findall(e, p, g), 'pos', 'v')}) q{k}" for k, (p, g) in enumerate(patterns))


def _firsts(most):
    return f"select doc_id, v as text, rank from (select doc_id, v, cast(row_number() over (partition by doc_id order by place, v) as bigint) as rank from (select doc_id, v, min(line_no * 10000 + pattern * 1000 + pos) as place from q group by doc_id, v) a) b where rank <= {most}"


def decisions(d):
    return (("q0", _found(d, DECISIONS)), ("q", f"select * from q0 where length(v) > 10 and length(v) < 150 and {d.size(d.split('v', ' '))} < 20"))


def timeline(d):
    kind = "case " + " ".join(f"when {d.match('line', p)} then '{t}'" for t, p in TIMELINE) + " end"
    return (
        ("m0", f"select doc_id, line_no, line, case when {d.match('line', ERROR_LINE)} then 0 else 1 end as late, {kind} as type from l"),
        ("m1", "select doc_id, line_no, case when late = 0 then 'error' else type end as type, case when late = 0 then substr(line, 1, 100) else substr(line, 1, 80) end as text, cast(row_number() over (partition by doc_id order by late, line_no) as bigint) as rank from m0 where late = 0 or type is not null"),
        ("m", "select * from m1 where rank <= 200"),
    )


def on(*more, select):
    return lambda d: query(lines(d), *(s for m in more for s in m(d)), ("", select(d) if callable(select) else select))


QUERIES = {
    "digest_files": on(text, files, select="select doc_id, path, rank, status, actions from fi where actions <> '' and rank <= 15"),
    "digest_errors": on(errors, select="select doc_id, signature, frequency, message, rank from (select *, cast(row_number() over (partition by doc_id order by frequency desc, first_line) as bigint) as rank from er) t where rank <= 15"),
    "error_signature_hash": on(errors, select="select doc_id, line_no, signature from e1"),
    "digest_fix_lookup": on(errors, fixes, select="select doc_id, signature, path, rank from (select *, cast(row_number() over (partition by doc_id, signature order by first_nth, path) as bigint) as rank from fx) t where rank <= 2"),
    "digest_decisions": on(decisions, select=_firsts(3)),
    "digest_milestones": on(lambda d: (("q0", _found(d, MILESTONES)), ("q", "select * from q0 where length(v) > 5 and length(v) < 200")), select=_firsts(5)),
    "digest_docs": on(lambda d: (("q", f"select doc_id, line_no, 0 as pattern, 0 as pos, {d.find('line', r'(?i)([^\s]+\.(?:md|txt|doc))', 1)} as v from l where {d.match('line', r'(?i)(\.md|\.txt|plan|agenda|roadmap)')} and {d.match('line', r'(?i)[^\s]+\.(md|txt|doc)')}"),), select=_firsts(5)),
    "digest_timeline": on(timeline, select="select doc_id, rank, line_no, type, text from m"),
    "digest_stats": on(text, files, errors, timeline, select="select a.doc_id, coalesce(n_files, 0) as n_files, coalesce(n_errors, 0) as n_errors, n_rows from (select doc_id, cast(count(*) as bigint) as n_rows from m group by doc_id) a left join (select doc_id, cast(count(*) as bigint) as n_files from fi group by doc_id) b on a.doc_id = b.doc_id left join (select doc_id, cast(count(*) as bigint) as n_errors from er group by doc_id) c on a.doc_id = c.doc_id"),
    "render_digest": on(errors, timeline, select=lambda d: f"select a.doc_id, concat('## Errors', chr(10), coalesce(errors, ''), chr(10), '## Timeline', chr(10), rows_) as digest from (select doc_id, {d.agg_join(chr(39) + '- ' + chr(39) + ' || type || ' + chr(39) + ': ' + chr(39) + ' || text', 'chr(10)', 'rank')} as rows_ from m where rank <= 15 group by doc_id) a left join (select doc_id, {d.agg_join('message', 'chr(10)', 'rank')} as errors from (select *, row_number() over (partition by doc_id order by frequency desc, first_line) as rank from er) e where rank <= 8 group by doc_id) b on a.doc_id = b.doc_id"),
}
