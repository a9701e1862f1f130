"""The recap document and the digest document, whole.

Defined results: every document with a line has a row; sections without entries
say so or are left out, as the fixed texts below have it. Status is pending for
every error: no step ever resolves one.
"""

from __future__ import annotations

from ..functions import rules as r
from . import digest, recap
from .digest import _firsts
from .logs import lines, staged
from .recap import clause, cut

# Labels and limits of the highlights, icons of the timeline, texts of empty sections.
HIGHLIGHTS = (("briefing", "Briefing", 3), ("command", "Investigations", 8), ("action", "Implementations", 8), ("decision", "Decisions", 5), ("note", "Notes", 3))
ICONS = (("action", "✅"), ("error", "❌"), ("decision", "🎯"), ("user_request", "❓"), ("model_response", "💭"))
MOST_PROBLEMS, MOST_BLOCKS, MOST_FILES, MOST_ERRORS = 6, 5, 8, 6
DIGEST_FILES, DIGEST_ERRORS = 12, 8


def problems(d):
    """The leading errors with the first two files that fixed them."""
    return (
        ("pr0", "select doc_id, signature, path, row_number() over (partition by doc_id, signature order by first_nth, path) as nth from fx"),
        ("pr1", f"select doc_id, signature, {d.agg_join('path', chr(39) + ', ' + chr(39), 'nth')} as paths from pr0 where nth <= 2 group by doc_id, signature"),
        ("er1", "select *, cast(row_number() over (partition by doc_id order by frequency desc, first_line) as bigint) as rank from er"),
        ("pr", f"select er1.doc_id, er1.rank, er1.signature, er1.message, er1.frequency, paths, concat({cut('message', 80)}, case when paths is null then '' else concat(' (affected ', paths, ')') end, ' — pending') as problem from er1 left join pr1 on er1.doc_id = pr1.doc_id and er1.signature = pr1.signature where er1.rank <= 15"),
    )


def monitored(d):
    return (("mo", f"select doc_id, path, status, {d.sub('actions', ',', ', ')} as actions, cast(row_number() over (partition by doc_id order by rank) as bigint) as nth from fi where actions <> '' and rank <= 15"),)


def highlights(d):
    """The distinct summaries of all chunks by group, then the last user turn."""
    limit = "case grp " + " ".join(f"when '{g}' then {n}" for g, _, n in HIGHLIGHTS) + " end"
    label = "case grp " + " ".join(f"when '{g}' then '{x}'" for g, x, _ in HIGHLIGHTS) + " end"
    order = "case grp " + " ".join(f"when '{g}' then {k}" for k, (g, _, _) in enumerate(HIGHLIGHTS)) + " end"
    return (
        ("hl0", f"select doc_id, grp, {r.trim(d, 'summary')} as summary, min(place) as place from ch where grp <> 'error' and {r.trim(d, 'summary')} <> '' group by doc_id, grp, {r.trim(d, 'summary')}"),
        ("hl1", "select *, cast(row_number() over (partition by doc_id, grp order by place) as bigint) as nth, cast(count(*) over (partition by doc_id, grp) as bigint) as n from hl0"),
        ("hl2", f"select doc_id, {order} as sort_key, concat({label}, ': ', {d.agg_join(cut(clause(d, 'summary'), 140), chr(39) + '; ' + chr(39), 'nth')}, case when max(n) > {limit} then concat(' (+', cast(max(n) - {limit} as string), ' more)') else '' end) as section from hl1 where nth <= {limit} group by doc_id, grp"),
        ("lu0", "select doc_id, max(idx) as idx from y where raw like 'USER:%' group by doc_id"),
        ("lu", f"select z.doc_id, {len(HIGHLIGHTS)} as sort_key, concat('Last User Interaction: ', {cut(clause(d, 'z.summary'), 140)}) as section from z join lu0 on z.doc_id = lu0.doc_id and z.idx = lu0.idx"),
        ("hi", "select doc_id, sort_key, section from hl2 union all select doc_id, sort_key, section from lu"),
    )


def recap_text(d):
    item = lambda e: f"concat('- ', {e})"
    return (
        ("nf", "select doc_id, cast(count(*) as bigint) as n_files from mo group by doc_id"),
        ("ne", "select doc_id, cast(count(*) as bigint) as n_errors from pr group by doc_id"),
        ("hs", f"select doc_id, {d.agg_join(item('section'), 'chr(10)', 'sort_key')} as highlights from hi group by doc_id"),
        ("iss", f"select doc_id, {d.agg_join(item('problem'), 'chr(10)', 'rank')} as issues from pr where rank <= {MOST_PROBLEMS} group by doc_id"),
        ("bk", f"select doc_id, chunk, {d.agg_join(item('section'), 'chr(10)', 'sort_key')} as listed, {d.agg_join('section', 'chr(10)', 'sort_key')} as plain from h group by doc_id, chunk"),
        ("tl", f"select doc_id, {d.agg_join('concat(' + chr(39) + '### Block ' + chr(39) + ', cast(chunk + 1 as string), chr(10), listed, chr(10))', 'chr(10)', 'chunk')} as timeline from bk group by doc_id"),
        (
            "rt",
            "select o0.doc_id, concat('## Overview', chr(10), 'Session touched ', cast(coalesce(n_files, 0) as string), ' files and ', cast(coalesce(n_errors, 0) as string), ' primary issues.', chr(10), chr(10),"
            " '## Highlights', chr(10), coalesce(highlights, '- No major highlights were extracted.'), chr(10), chr(10), '## Issues & Resolutions', chr(10), coalesce(issues, '- No critical issues highlighted.'), chr(10), chr(10),"
            " '## Next Steps', chr(10), '- Define next steps based on the timeline above.', chr(10), chr(10), '## Detailed Timeline', case when timeline is null then '' else concat(chr(10), timeline) end) as recap"
            " from o0 left join nf on o0.doc_id = nf.doc_id left join ne on o0.doc_id = ne.doc_id left join hs on o0.doc_id = hs.doc_id left join iss on o0.doc_id = iss.doc_id left join tl on o0.doc_id = tl.doc_id",
        ),
    )


def output_text(d):
    """The recap with block overview, files, errors and footer."""
    block = "concat('### Chunk ', cast(chunk + 1 as string), ' (local)', chr(10), plain, chr(10))"
    file = "concat('- ', path, ' (', status, ') – ', actions)"
    error = "concat('- ', signature, ': ', substr(message, 1, 120), case when length(message) > 120 then '...' else '' end)"
    section = lambda title, e: f"case when {e} is null then '' else concat('## {title}', chr(10), chr(10), {e}, chr(10), chr(10)) end"
    return (
        ("ob", f"select doc_id, {d.agg_join(block, 'chr(10)', 'chunk')} as blocks from bk where chunk < {MOST_BLOCKS} group by doc_id"),
        ("ofi", f"select doc_id, {d.agg_join(file, 'chr(10)', 'nth')} as files from mo where nth <= {MOST_FILES} group by doc_id"),
        ("oe", f"select doc_id, {d.agg_join(error, 'chr(10)', 'rank')} as errors from pr where rank <= {MOST_ERRORS} group by doc_id"),
        (
            "ot",
            f"select rt.doc_id, concat({r.trim(d, 'recap')}, chr(10), chr(10), case when blocks is null then '' else concat('## Block Overview', chr(10), chr(10), blocks, chr(10)) end, {section('Monitored Files', 'files')}, {section('Highlighted Errors', 'errors')}, '---', chr(10), 'Generated by loomlight') as output"
            " from rt left join ob on rt.doc_id = ob.doc_id left join ofi on rt.doc_id = ofi.doc_id left join oe on rt.doc_id = oe.doc_id",
        ),
    )


class on(staged):
    CUTS = ("y", "z", "er", "fx", "fi", "ch", "h", "pr", "mo")


def _recap(*more, select):
    parts = (recap.events, recap.briefing, digest.errors, lambda d: recap.timeline(d)[:1], recap.whole_timeline, recap.whole_chunks, recap.sections, digest.fixes, digest.text, digest.files, problems, monitored, highlights, recap_text)
    return on(recap.turns, *parts, *more, select=select)


def firsts(name, found, most):
    """Steps of the first distinct texts found, as one list of items."""
    def steps(d):
        return (*((f"{name}_{n}", text.replace(" from q0", f" from {name}_q0")) for n, text in found(d)), (f"{name}_r", _firsts(most).replace(" from q ", f" from {name}_q ")), (name, f"select doc_id, {d.agg_join('concat(' + chr(39) + '- ' + chr(39) + ', text)', 'chr(10)', 'rank')} as {name} from {name}_r group by doc_id"))

    return steps


def _milestones(d):
    return (("q0", digest._found(d, digest.MILESTONES)), ("q", "select * from q0 where length(v) > 5 and length(v) < 200"))


def _docs(d):
    return (("q", f"select doc_id, line_no, 0 as pattern, 0 as pos, {d.find('line', r'(?i)([^\s]+\.(?:md|txt|doc))', 1)} as v from l where {d.match('line', r'(?i)(\.md|\.txt|plan|agenda|roadmap)')} and {d.match('line', r'(?i)[^\s]+\.(md|txt|doc)')}"),)


def digest_text(d):
    """The digest document: files, errors with fixes, milestones, decisions, documentation, timeline with icons."""
    icon = "case type " + " ".join(f"when '{t}' then '{i}'" for t, i in ICONS) + " else '📌' end"
    file = "concat('- **', path, '**', chr(10), '  - Status: ', status, chr(10), '  - Actions: ', actions)"
    error = "concat('- **', signature, '**', chr(10), '  - Message: ', substr(message, 1, 120), '...', case when frequency > 1 then concat(chr(10), '  - Occurrences: ', cast(frequency as string)) else '' end, case when paths is null then '' else concat(chr(10), '  - Fixed in: ', paths) end)"
    section = lambda title, e: f"case when {e} is null then '' else concat(chr(10), '### {title}', chr(10), chr(10), {e}, chr(10)) end"
    names = ("dfl", "der", "dmi", "dde", "ddo", "dtl")
    columns = dict(zip(names, ("files", "errors", "dmi", "dde", "ddo", "timeline")))
    titles = ("📁 Main Modified Files", "🐛 Errors and Fixes", "🎯 Milestones/Phases", "💡 Main Decisions", "📋 Documentation Files", "⏱️ Event Timeline")
    return (
        ("dd", "select distinct doc_id from l"),
        ("dfl", f"select doc_id, {d.agg_join(file, 'chr(10)', 'nth')} as files from mo where nth <= {DIGEST_FILES} group by doc_id"),
        ("der", f"select doc_id, {d.agg_join(error, 'chr(10)', 'rank')} as errors from pr where rank <= {DIGEST_ERRORS} group by doc_id"),
        ("dtl", f"select doc_id, {d.agg_join(f'concat({icon}, ' + chr(39) + ' [' + chr(39) + ', type, ' + chr(39) + '] ' + chr(39) + ', text)', 'chr(10)', 'rank')} as timeline from m group by doc_id"),
        ("dt", f"select dd.doc_id, concat('## Session Summary (Structured Compression)', chr(10), {', '.join(section(t, f'{n}.{columns[n]}') for n, t in zip(names, titles))}) as digest from dd " + " ".join(f"left join {n} on dd.doc_id = {n}.doc_id" for n in names)),
    )


QUERIES = {
    "turn_errors": on(recap.turns, digest.errors, select="select y.doc_id, y.idx, er.signature from y join er on y.doc_id = er.doc_id where instr(y.raw, er.signature) > 0 or instr(y.raw, substr(er.message, 1, 50)) > 0"),
    "recap_problem_lines": _recap(select="select doc_id, rank, signature, problem from pr where rank <= 6"),
    "recap_highlight_sections": _recap(select="select doc_id, sort_key, section from hi"),
    "render_recap_document": _recap(select="select doc_id, recap from rt"),
    "render_recap_output": _recap(output_text, select="select doc_id, output from ot"),
    "render_digest_document": on(lambda d: (lines(d),), digest.errors, digest.fixes, digest.text, digest.files, digest.timeline, problems, monitored, firsts("dmi", _milestones, 5), firsts("dde", digest.decisions, 3), firsts("ddo", _docs, 5), digest_text, select="select doc_id, digest from dt"),
}
