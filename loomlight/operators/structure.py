"""Structural patterns of lines, groups by structural signature, and structural similarity.

Lines with equal patterns and signature are one class: similarities are between
classes, `struct_groups` has the class of every line. Queries are the classes
that hold a line of a document whose id is divisible by 50, against all classes.
"""

from __future__ import annotations

from .logs import lines, query

# Name, pattern, category and priority of the structural patterns.
PATTERNS = (
    ("http_error", r"(?i)(GET|POST|PUT|DELETE|PATCH)\s+http[s]?://[^\s]+ (\d{3})", "HTTP", 1),
    ("stacktrace_java", r"\s+at\s+[^\s]+\([^)]+\)", "StackTrace", 1),
    ("stacktrace_python", r'(?i)\s+File\s+"[^"]+",\s+line\s+\d+,', "StackTrace", 1),
    ("log_level_timestamp", r"(?i)\[(DEBUG|INFO|WARN|ERROR|FATAL|TRACE)\]\s+\d{4}-\d{2}-\d{2}", "LogEntry", 2),
    ("uuid_reference", r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "UUID", 3),
    ("json_error_response", r'(?i)"error"\s*:\s*\{[^}]*"message"\s*:\s*"[^"]*"', "JSON", 2),
    ("database_error", r"(?i)(SQLSTATE|ORA-|MySQL|PostgreSQL).*error", "Database", 1),
    ("auth_error", r"(?i)(unauthorized|forbidden|authentication.*failed|invalid.*token)", "Authentication", 1),
    ("network_error", r"(?i)(connection.*refused|timeout|ECONNRESET|ENOTFOUND)", "Network", 1),
    ("file_system_error", r"(?i)(ENOENT|EACCES|EPERM|file.*not.*found)", "FileSystem", 1),
)
PARTS = (
    (r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "{UUID}"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z?", "{TIMESTAMP}"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "{IP}"),
    (r"https?://[^\s]+", "{URL}"),
    (r"\d+", "{NUMBER}"),
    (r'"[^"]*"', "{STRING}"),
    (r"\x27[^\x27]*\x27", "{STRING}"),
)


def signature(d, e):
    for p, to in PARTS:
        e = d.sub(e, p, to)
    return e


def named(d, e, want=lambda p: p[0], keep=lambda p: True):
    """List of the names (or what `want` takes) of the patterns that a text has."""
    return d.filter(d.list(*(f"case when {d.match(e, p[1])} then '{want(p)}' else '' end" for p in PATTERNS if keep(p))), "x <> ''")


def classes(d):
    """Class of each line, and per class its patterns, leading patterns, categories and structural elements."""
    elements = d.filter(d.split("shape", r"[^a-zA-Z0-9{}_-]"), "x like '%{%'")
    lead = d.filter("patterns", "x in (" + ", ".join(f"'{p[0]}'" for p in PATTERNS if p[3] == 1) + ")")
    kinds = d.map("patterns", "case x " + " ".join(f"when '{p[0]}' then '{p[2]}'" for p in PATTERNS) + " end")
    return (
        ("z0", f"select doc_id, line_no, line, {named(d, 'line')} as patterns, {signature(d, 'line')} as shape from l"),
        ("z1", f"select doc_id, line_no, shape, {d.join('patterns', chr(39) + ',' + chr(39))} as names from z0"),
        ("z2", f"select shape, {d.join('patterns', chr(39) + ',' + chr(39))} as names, min(doc_id * 1000000 + line_no) as class, cast(count(*) as bigint) as n_lines, max(case when doc_id % 50 = 0 then 1 else 0 end) as asked, {d.first_by('patterns', 'doc_id * 1000000 + line_no')} as patterns from z0 group by shape, {d.join('patterns', chr(39) + ',' + chr(39))}"),
        ("z3", f"select *, {lead} as lead, {d.distinct_sorted(kinds)} as kinds, {elements} as elements from z2"),
    )


def similar(d):
    """Every asked class against all others."""
    n = lambda a, b: d.size(d.both(a, b))
    has = "array_contains(e, x)" if d.name == "spark" else "list_contains(e, x)"
    common = d.size(d.let("e", "b.elements", d.filter("a.elements", has)))
    most = f"greatest({d.size('a.elements')}, {d.size('b.elements')})"
    return (
        ("y0", f"select a.class as a, b.class as b, {n('a.lead', 'b.lead')} as n_lead, {n('a.kinds', 'b.kinds')} as n_kinds, {common} as n_elements, {most} as most, a.shape = b.shape as same from z3 a join z3 b on a.class <> b.class where a.asked = 1"),
        ("y1", "select *, case when n_lead > 0 then 0.9 + n_lead * 0.05 when n_kinds > 0 then 0.7 + n_kinds * 0.1 when same then 0.8 when most > 0 then cast(n_elements as double) / most * 0.6 else 0.0 end as s from y0"),
    )


def on(*more, select):
    return lambda d: query(lines(d), *(s for m in more for s in m(d)), ("", select(d) if callable(select) else select))


QUERIES = {
    "struct_patterns": on(select=lambda d: f"select name, category, priority, n from (select name, cast(count(*) as bigint) as n from ({d.explode('l', 'doc_id', named(d, 'line'), 'i', 'name')}) q group by name) c join (" + " union all ".join(f"select '{p[0]}' as pattern, '{p[2]}' as category, {p[3]} as priority" for p in PATTERNS) + ") p on name = pattern"),
    "struct_signature": on(select=lambda d: f"select doc_id, line_no, {signature(d, 'line')} as shape from l"),
    "struct_groups": on(classes, select="select z1.doc_id, z1.line_no, z2.class, z2.n_lines from z1 join z2 on z1.shape = z2.shape and z1.names = z2.names"),
    "struct_similarity": on(classes, similar, select="select a, b, n_lead, n_kinds, n_elements, round(cast(s as double), 6) as similarity, round(cast(case when s >= 0.8 then s else s * 0.5 end as double), 6) as enhanced, (s >= 0.9 or (s >= 0.8 and n_lead > 0)) as together from y1 where s > 0"),
}
