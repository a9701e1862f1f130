"""The compression document: clusters with variables and samples, unique events, all sections joined.

Defined results: a document without lines has no row; one without clusters has
an empty cluster section; texts are cut by code points, lists by the fixed limits.
"""

from __future__ import annotations

from ..functions import rules as r
from .logs import error_text, lines, query, relevant, scenario, staged, summary, upto_clusters

# Limits of the document, and the parts of a line that a cut keeps.
MOST_CHARS, MOST_CLUSTERS, MOST_OTHER, MOST_UNIQUE = 240, 20, 5, 3
SAMPLE_LINES, UNIQUE_LINES, VALUES, CATEGORIES = 10, 8, 5, 3
HTTP = r"(?i)^\s*(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s+(\S+)\s+(\d{3}\b\S*)"
PLACE = r"([A-Za-z0-9_.\-/]+:\d+)"
MARK = r"(?s)^(.*?(?:ERROR:|Error:|Exception:).{0,20})"


def essential(d, e):
    """What a cut keeps of a line: request and status, file and line, or the head of an error; '' if none."""
    http = f"concat({d.find(e, HTTP, 1)}, ' ', {d.find(e, HTTP, 2)}, ' ', {d.find(e, HTTP, 3)})"
    return f"case when {d.match(e, HTTP)} then {http} when {d.match(e, PLACE)} then {d.find(e, PLACE, 1)} else substr({d.find(e, MARK, 1)}, 1, {MOST_CHARS}) end"


def shortened(d, src, keep, e, out):
    """Steps that give src's columns `keep` and `out`: e cut to about MOST_CHARS, with both ends kept."""
    tail = f"cast(greatest(10, floor(({MOST_CHARS} - 5 - length(head)) / 2.0)) as int)"
    last = lambda n: f"substr({e}, greatest(1, length({e}) - {n} + 1))"
    some = MOST_CHARS // 2
    return (
        (f"{src}_h", f"select *, case when length({e}) > {MOST_CHARS} then {essential(d, e)} else '' end as head from {src}"),
        (f"{src}_c", f"select {keep}, {e} as whole_{out}, case when length({e}) <= {MOST_CHARS} then {e} when head <> '' and {MOST_CHARS} - 5 - length(head) > 0 then concat(head, case when length({e}) > length(head) + {tail} then ' … ' else ' ' end, {last(tail)}) else concat(substr({e}, 1, {some}), ' … ', {last(some)}) end as {out} from {src}_h"),
    )


def samples(d):
    """The lines of each cluster's first event: runs of like lines once, with a note; shortened."""
    note = "concat('/* Pattern repeated ', cast(times as string), '×', chr(10), '   First occurrence:', chr(10), '   ', whole_line, chr(10), '*/')"
    return (
        ("m0", f"select f.doc_id, f.ord, f.pos, f.line, {r.normalize(d, 'f.line')} as norm from f join cl on f.doc_id = cl.doc_id and f.ord = cl.first_ord"),
        ("m1", "select *, case when norm = lag(norm) over (partition by doc_id, ord order by pos) then 0 else 1 end as starts from m0"),
        ("m2", "select *, sum(starts) over (partition by doc_id, ord order by pos rows between unbounded preceding and current row) as run from m1"),
        ("m3", f"select doc_id, ord, run, cast(count(*) as bigint) as times, {d.first_by('line', 'pos')} as line from m2 group by doc_id, ord, run"),
        *shortened(d, "m3", "doc_id, ord, run, times", "line", "line"),
        ("m4", f"select doc_id, ord, 2 * run as place, line from m3_c union all select doc_id, ord, 2 * run + 1 as place, {note} as line from m3_c where times > 1"),
        ("m5", "select *, cast(row_number() over (partition by doc_id, ord order by place) as bigint) as nth, cast(count(*) over (partition by doc_id, ord) as bigint) as n from m4"),
        (
            "sm",
            "select doc_id, ord"
            + "".join(
                f", concat({d.agg_join(f'case when nth <= {most} then line end', 'chr(10)', 'nth')}, case when max(n) > {most} then concat(chr(10), '… (', cast(max(n) - {most} as string), ' lines omitted)') else '' end) as {name}"
                for name, most in (("sample", SAMPLE_LINES), ("few", UNIQUE_LINES))
            )
            + " from m5 group by doc_id, ord",
        ),
    )


def ranked(d):
    """Clusters by size; five of category Other at most, which come last; their number."""
    return (
        ("k1", "select *, case when category = 'Other' then row_number() over (partition by doc_id, category order by n_events desc, first_ord) else 0 end as other from cl"),
        ("kr", f"select *, cast(row_number() over (partition by doc_id order by case when category = 'Other' then 1 else 0 end, n_events desc, first_ord) as bigint) as rank, cast(count(*) over (partition by doc_id) as bigint) as n_clusters from k1 where other <= {MOST_OTHER}"),
    )


def variables(d):
    """Per cluster the distinct ids of all its events, in order of first mention: the first five and their number."""
    return (
        ("i0", "select doc_id, signature, ord from c0"),
        ("i1", "select i0.doc_id, i0.signature, f.ord, f.pos, f.line from i0 join f on i0.doc_id = f.doc_id and i0.ord = f.ord"),
        ("i2", d.explode("i1", "doc_id, signature, ord, pos", r.placeholder_values(d, "line"), "i", "v")),
        ("i3", "select doc_id, signature, v, min(ord * 1000000000 + pos * 10000 + i) as place from i2 group by doc_id, signature, v"),
        ("i4", "select *, cast(row_number() over (partition by doc_id, signature order by place) as bigint) as nth, cast(count(*) over (partition by doc_id, signature) as bigint) as n from i3"),
        ("va", f"select doc_id, signature, max(n) as n_values, concat('- {{ID}}: ', {d.agg_join('v', chr(39) + ', ' + chr(39), 'nth')}, case when max(n) > {VALUES} then concat(', … (', cast(max(n) as string), ' values)') else '' end) as variables from i4 where nth <= {VALUES} group by doc_id, signature"),
    )


def related(d):
    """Per cluster its three most frequent categories."""
    return (
        ("g0", "select doc_id, signature, category, cast(count(*) as bigint) as n, min(ord) as first from c0 group by doc_id, signature, category"),
        ("g1", "select *, cast(row_number() over (partition by doc_id, signature order by n desc, first) as bigint) as nth, cast(count(*) over (partition by doc_id, signature) as bigint) as kinds from g0"),
        ("ca", f"select doc_id, signature, concat({d.agg_join('concat(category, ' + chr(39) + ' (' + chr(39) + ', cast(n as string), ' + chr(39) + ')' + chr(39) + ')', chr(39) + ', ' + chr(39), 'nth')}, case when max(kinds) > {CATEGORIES} then concat(', … (', cast(max(kinds) - {CATEGORIES} as string), ' additional categories)') else '' end) as categories from g1 where nth <= {CATEGORIES} group by doc_id, signature"),
    )


def blocks(d):
    """The text of every rendered cluster."""
    title = d.explode("kr", "doc_id, signature, rank", d.slice(d.split("template", r"\n"), "1", "3"), "i", "line")
    return (
        ("t1", title),
        *shortened(d, "t1", "doc_id, signature, rank, i", "line", "line"),
        ("tp", f"select doc_id, signature, {d.first_by('line', 'i')} as representative, {d.agg_join('concat(' + chr(39) + '- ' + chr(39) + ', line)', 'chr(10)', 'i')} as preview from t1_c group by doc_id, signature"),
        (
            "bl",
            "select kr.doc_id, kr.signature, kr.rank, kr.n_clusters, concat('### Cluster ', cast(kr.rank as string), ' (', cast(n_events as string), ' occurrence', case when n_events > 1 then 's' else '' end, ')', chr(10), 'Representative: ', representative, chr(10), 'Template (preview):', chr(10), preview, chr(10),"
            " case when variables is null then '' else concat('Variables:', chr(10), variables, chr(10)) end, 'Related categories: ', ca.categories, chr(10), 'Sample:', chr(10), sample) as block"
            " from kr join tp on kr.doc_id = tp.doc_id and kr.signature = tp.signature join ca on kr.doc_id = ca.doc_id and kr.signature = ca.signature join sm on kr.doc_id = sm.doc_id and kr.first_ord = sm.ord"
            f" left join va on kr.doc_id = va.doc_id and kr.signature = va.signature where kr.rank <= {MOST_CLUSTERS}",
        ),
    )


def unique(d):
    return (
        ("w0", f"select kr.doc_id, first_ord, ev.score, cast(row_number() over (partition by kr.doc_id order by first_ord) as bigint) as nth, cast(count(*) over (partition by kr.doc_id) as bigint) as n from kr join ev on kr.doc_id = ev.doc_id and kr.first_ord = ev.ord where n_events = 1 and {relevant(d, 'kr.body')}"),
        ("w1", f"select w0.doc_id, nth, n, concat('- Order ', cast(first_ord as string), ' | Score ', cast(score as string), chr(10), few) as part from w0 join sm on w0.doc_id = sm.doc_id and w0.first_ord = sm.ord where nth <= {MOST_UNIQUE}"),
        ("un", f"select doc_id, concat('## Unique Events', chr(10), {d.agg_join('part', 'chr(10)', 'nth')}, case when max(n) > {MOST_UNIQUE} then concat(chr(10), '- … (', cast(max(n) - {MOST_UNIQUE} as string), ' additional unique events omitted)') else '' end) as uniques from w1 group by doc_id"),
    )


def document(d):
    """All sections of a document, those that it has."""
    return (
        *scenario(d),
        *summary(d),
        *error_text(d),
        ("cs", f"select doc_id, concat({d.agg_join('block', 'concat(chr(10), chr(10))', 'rank')}, case when max(n_clusters) > {MOST_CLUSTERS} then concat(chr(10), chr(10), '… (', cast(max(n_clusters) - {MOST_CLUSTERS} as string), ' additional clusters omitted)', chr(10)) else '' end) as clusters from bl group by doc_id"),
        ("ds", "select distinct doc_id from l"),
    )


class on(staged):
    CUTS = ("f", "ev", "c0", "cl", "sm", "kr")

    def __init__(self, *more, select):
        super().__init__(upto_clusters, *more, select=select)


def _lines_short(d):
    long = "case when line_no % 7 = 0 then concat(line, ' ', repeat(concat(line, ' / '), 6)) else line end"
    return query(lines(d), ("l0", f"select doc_id, line_no, {r.redact(d, 'line')} as line from l"), ("l1", f"select doc_id, line_no, {long} as line from l0"), *shortened(d, "l1", "doc_id, line_no", "line", "short"), ("", "select doc_id, line_no, short from l1_c"))


_PART = "case when {0} is null then '' else concat({0}, chr(10), chr(10)) end"

QUERIES = {
    "lines_truncate": _lines_short,
    "cluster_samples": on(ranked, samples, select="select kr.doc_id, kr.first_ord, sample, few from kr join sm on kr.doc_id = sm.doc_id and kr.first_ord = sm.ord"),
    "cluster_variables": on(variables, select="select doc_id, signature, n_values, variables from va"),
    "cluster_categories": on(related, select="select doc_id, signature, categories from ca"),
    "render_clusters": on(ranked, samples, variables, related, blocks, select="select doc_id, rank, n_clusters, block from bl"),
    "render_unique_events": on(ranked, samples, unique, select="select doc_id, uniques from un"),
    "render_document": on(
        ranked,
        samples,
        variables,
        related,
        blocks,
        unique,
        document,
        select=f"select ds.doc_id, concat({_PART.format('scenario')}, {_PART.format('summary')}, '## Event Clusters', case when clusters is null then '' else concat(chr(10), chr(10), clusters) end, case when uniques is null then '' else concat(chr(10), chr(10), uniques) end) as document from ds left join st on ds.doc_id = st.doc_id left join es on ds.doc_id = es.doc_id left join cs on ds.doc_id = cs.doc_id left join un on ds.doc_id = un.doc_id",
    ),
}
