"""Recap of a transcript: relevance, event types, timeline, chunks, summaries; chat parsing.

The transcript has a turn for each log line, spoken by the user or the agent.
"""

from __future__ import annotations

from ..functions import rules as r
from ..sources.logs import LINES
from .digest import DECISIONS, ERROR_LINE, FILES, errors, valid_path
from .logs import query, staged
from .turns import turn_type

# Words and patterns of the recap.
VERBS = r"(add|create|update|delete|fix|refactor|run|change|modify|configure|debug|investigate|implement|deploy|test)"
NOISE = r"(?i)no matches found|file not found|regex search results|here\x27s the result|note:\nend line|total lines in file|successfully edited|file saved|command completed|\{.*?\}|\[.*?\]|encrypted_content|tool_use_id|⚠️|run out of credits"
ISSUE = r"error|failed|exception|panic|crash|timeout|fatal|segfault"
COMMAND = r"(?i)bash -lc|rg -n|ls -la|pnpm|npm|yarn|git\s|xcode|gradle|adb|fastlane|flutter|expo|buck|bazel"
CHANGE = r"(?i)(added|created|updated|implemented|refactor|hook|dialog|route|screen|view|component|service|controller|handler|api|endpoint|migration|schema|adapter|widget|fragment|activity|swift|kotlin|objective-c|java|android|ios|react native|lambda|cloud|infra|terraform|helm|docker|kubernetes|monitoring|telemetry|ci|cd)"
PLAN = r"(?i)(decide|plan|milestone|stack|should focus|roadmap|next steps|prioritize|strategy|architecture|approach|proposal)"
COMMAND_LINE = r"^\s*(\d{2,5})\s+-"
DETAIL_VERB, DASHES = r"(?i)^(Updated|Refactored|Changed|Fixed|Added)\s+", r"^[\x{2014}\x{2013}\-:]+\s*"
MOST_EVENTS, MOST_CHARS = 80, 18_000
GROUPS = (("briefing", "Initial context", 3), ("command", "Investigations", 4), ("action", "Implementation", 5), ("error", "Issues", 5), ("decision", "Decisions", 3), ("note", "Notes", 3))


def narrative(d, e):
    for p, to in ((r"^\s*[-•]+\s*", ""), (r"^\d+\s+\+\s+", ""), (r"(?i)^\s*(Implementation|Investigation|Issues?|Notes?):\s*", ""), (r"\\n", " "), (r"└.*$", ""), (r"\s+", " ")):
        e = d.sub(e, p, to)
    return r.trim(d, e)


def clause(d, e):
    first = d.at(d.filter(d.map(d.split(e, r"(?:;|\s{2,}| -- | — | – )+"), r.trim(d, "x")), "x <> ''"), "1")
    return f"coalesce({first}, {r.trim(d, e)})"


def cut(e, most):
    return f"case when length({e}) > {most} then concat(substr({e}, 1, {most}), '…') else {e} end"


def turns(d):
    files = d.concat_lists(*(d.filter(d.findall("raw", p, g), valid_path(d, "x")) for p, g in FILES))
    said = "case when line_no % 4 = 0 or line_no < 2 then 'USER: ' else 'AGENT: ' end"
    json = d.count("raw", r"\{|\}|\[|\]|\".*?\":")
    penalty = f"case when cast({json} as double) / greatest(length(raw), 1) > 0.05 then least(20 * cast({json} as double) / greatest(length(raw), 1), 10.0) else 0.0 end"
    score = (
        f"(case when raw like 'USER:%' then 5 else 0 end) + 2 * n_files + n_errors + (case when {d.match('lower(raw)', VERBS)} then 1 else 0 end) + (case when {d.match('raw', r'(?i)src/|lib/|\.js|\.ts')} then 1 else 0 end)"
        f" - (case when {d.match('lower(raw)', r'error|exit code|failed to build|auth_expired|⚠️|you have run out of credits')} then 5 else 0 end) - (case when {d.match('raw', r'log =>|CACHED|COPY|\.npmrc|package-lock')} then 2 else 0 end)"
        f" - {penalty} + least(cast(length(raw) as double) / 100, 2.0) + cast(idx as double) / 100"
    )
    kind = f"case when type = 'error' or {d.match('lower(body)', ISSUE)} then 'error' when {d.match('body', COMMAND)} then 'action' when type = 'action' or {d.match('body', CHANGE)} then 'action' when type = 'decision' or tagged or {d.match('body', PLAN)} then 'decision' else 'note' end"
    intent = f"case when type = 'error' or {d.match('lower(body)', ISSUE)} then 'issue' when {d.match('body', COMMAND)} then 'command' when type = 'action' or {d.match('body', CHANGE)} then 'code_change' when type = 'decision' or tagged or {d.match('body', PLAN)} then 'decision' else 'note' end"
    return (
        ("l", LINES),
        ("y0", f"select doc_id, line_no as idx, concat({said}, line) as raw, line, {turn_type(d, 'line')} as type from l where {r.trim(d, 'line')} <> ''"),
        ("y1", f"select *, {d.sub('raw', r'^USER:\s*|^AGENT:\s*', '')} as body, {d.distinct_sorted(files)} as files, case when {d.match('line', ERROR_LINE)} then 1 else 0 end as n_errors, ({' or '.join(d.match('line', p) for p, _ in DECISIONS)}) as tagged from y0"),
        ("y2", f"select *, {d.size('files')} as n_files, {narrative(d, 'body')} as clean from y1"),
        ("y", f"select *, round({score}, 6) as score, {kind} as kind, {intent} as intent from y2"),
    )


def events(d):
    """Turns that pass the noise and relevance filters, with their summaries; repeated commands once."""
    focus = "focus"
    decision = f"case when {d.match('lower(focus)', '^(will|should|plan|decided|prioritize|focus)')} then concat('Decision: ', {cut(focus, 200)}) else concat('Decision: ', {cut(chr(40) + 'concat(' + chr(39) + 'to ' + chr(39) + ', focus)' + chr(41), 200)}) end"
    verb = "case " + " ".join(f"when {d.match('focus', '(?i)' + p)} then '{v}'" for p, v in (("implement", "Implemented"), ("refactor", "Refactored"), ("update", "Updated"), ("create", "Created"), ("add", "Added"), ("fix", "Fixed"), ("ran", "Ran"))) + " else 'Changed' end"
    low = "lower(clean)"
    shell = d.match(low, "bash -lc")
    outcomes = (
        (d.match("clean", COMMAND_LINE), f"concat('Inspected code around line ', {d.find('clean', COMMAND_LINE, 1)})"),
        (d.match(low, "rg -n|ripgrep"), "'Scanned repository with ripgrep'"),
        (d.match(low, "ls -"), "'Listed directories to map artifacts'"),
        (d.match(low, "pnpm lint|npm run lint|yarn lint"), "'Ran lint to validate types/rules'"),
        (d.match(low, "git status"), "'Checked repository status (git status)'"),
        (f"{shell} and {d.match(low, 'nl -ba')}", "'Read files with numbering for contextual review'"),
        (f"{shell} and {d.match(low, 'rg')}", "'Executed custom grep to locate routes/plans'"),
    )
    command = "case " + " ".join(f"when {c} then {v}" for c, v in outcomes) + f" else concat('Ran command: ', {cut('clean', 160)}) end"
    named = f"concat({verb}, ' ', {d.join(d.slice('files', '1', '2'), chr(39) + ', ' + chr(39))}, ' – ', {cut('detail', 160)})"
    return (
        ("z0", f"select *, {clause(d, 'clean')} as focus from y where score >= 4 and not {d.match('raw', NOISE)} and not (kind = 'error' and score < 5) and not (kind = 'note' and n_files = 0 and n_errors = 0)"),
        # the detail of a change: without the first file, its verb and dashes
        ("z0a", f"select *, {d.at('files', '1')} as file from z0"),
        ("z0b", "select *, cast(case when file is null then 0 else instr(lower(focus), lower(file)) end as int) as file_at from z0a"),
        ("z0c", f"select *, {d.sub(r.trim(d, d.sub(r.trim(d, 'case when file_at > 0 then concat(substr(focus, 1, file_at - 1), substr(focus, file_at + length(file))) else focus end'), DETAIL_VERB, '')), DASHES, '')} as rest from z0b"),
        ("z0d", f"select *, {clause(d, 'rest')} as detail from z0c"),
        ("z1", f"select *, case when intent = 'command' then {command} when intent = 'decision' then {decision} when n_files > 0 then {named} else {cut(focus, 200)} end as summary from z0d where clean <> ''"),
        ("z2", "select *, row_number() over (partition by doc_id, intent, summary order by idx) as copy from z1"),
        ("z", "select * from z2 where intent <> 'command' or copy = 1"),
    )


def briefing(d):
    """The first unbroken run of user turns."""
    return (
        ("b0", "select doc_id, idx, body, raw like 'USER:%' as mine, sum(case when raw like 'USER:%' then 0 else 1 end) over (partition by doc_id order by idx rows between unbounded preceding and current row) as others from y"),
        ("b1", "select *, min(case when mine then others end) over (partition by doc_id) as before from b0"),
        ("br", "select doc_id, idx, body, cast(row_number() over (partition by doc_id order by idx) as bigint) as nth from b1 where mine and others = before"),
    )


def timeline(d):
    """All user events and the newest others up to the limit, in order."""
    return (
        ("o0", "select doc_id, cast(greatest(400, least(2400, floor(count(*) * 0.75))) as bigint) as most from y group by doc_id"),
        ("o1", "select z.*, case when raw like 'USER:%' then 1 else 0 end as user from z" if d.name == "spark" else "select z.*, case when raw like 'USER:%' then 1 else 0 end as \"user\" from z"),
        ("o2", 'select o1.*, most, sum({u}) over (partition by o1.doc_id) as n_user, row_number() over (partition by o1.doc_id, {u} order by idx desc) as newest from o1 join o0 on o1.doc_id = o0.doc_id'.format(u="user" if d.name == "spark" else '"user"')),
        ("o", "select *, cast(row_number() over (partition by doc_id order by idx) - 1 as bigint) as place from o2 where {u} = 1 or newest <= most - n_user".format(u="user" if d.name == "spark" else '"user"')),
    )


def whole_timeline(d):
    """The briefing, all user events and the newest others in the slots left, in order; then the five leading errors."""
    return (
        ("v0", "select doc_id, cast(count(*) as bigint) as n_brief from br where nth <= 3 group by doc_id"),
        ("v1", "select o0.doc_id, most - coalesce(n_brief, 0) as room from o0 left join v0 on o0.doc_id = v0.doc_id"),
        ("v2", "select z.*, room, case when raw like 'USER:%' then 1 else 0 end as said from z join v1 on z.doc_id = v1.doc_id"),
        ("v3", "select *, sum(said) over (partition by doc_id) as n_said, row_number() over (partition by doc_id, said order by idx desc) as newest from v2"),
        ("v4", "select *, row_number() over (partition by doc_id order by frequency desc, first_line) as rank from er"),
        (
            "v5",
            f"select doc_id, 0 as part, nth - 1 as ord, 0 as late, idx, 'briefing' as kind, cast(null as string) as intent, {r.trim(d, 'body')} as summary from br where nth <= 3"
            " union all select doc_id, 0 as part, idx as ord, 1 as late, idx, kind, intent, summary from v3 where said = 1 or newest <= room - n_said"
            f" union all select doc_id, 1 as part, rank as ord, 0 as late, cast(null as bigint) as idx, 'error' as kind, cast(null as string) as intent, concat('Error ', signature, ': ', {cut('message', 180)}) as summary from v4 where rank <= 5",
        ),
        ("o", "select *, cast(row_number() over (partition by doc_id order by part, ord, late) - 1 as bigint) as place from v5"),
    )


def whole_chunks(d):
    return (("ch", f"select *, cast(floor(place / {MOST_EVENTS}) as bigint) as chunk, case when kind = 'briefing' then 'briefing' when intent = 'command' then 'command' when kind in ('action', 'error', 'decision') then kind else 'note' end as grp from o"),)


def chunks(d, most=20):
    return (("ch", f"select *, cast(floor(place / {most}) as bigint) as chunk, case when intent = 'command' then 'command' when kind in ('action', 'error', 'decision') then kind else 'note' end as grp from o"),)


def sections(d):
    limit = "case grp " + " ".join(f"when '{g}' then {n}" for g, _, n in GROUPS) + " end"
    label = "case grp " + " ".join(f"when '{g}' then '{x}'" for g, x, _ in GROUPS) + " end"
    order = "case grp " + " ".join(f"when '{g}' then {k}" for k, (g, _, _) in enumerate(GROUPS)) + " end"
    return (
        ("h0", "select doc_id, chunk, grp, summary, min(place) as place from ch group by doc_id, chunk, grp, summary"),
        ("h1", "select *, cast(row_number() over (partition by doc_id, chunk, grp order by place) as bigint) as nth, cast(count(*) over (partition by doc_id, chunk, grp) as bigint) as n from h0"),
        ("h", f"select doc_id, chunk, grp, {order} as sort_key, max(n) as n, concat({label}, ': ', {d.agg_join(cut(clause(d, 'summary'), 140), chr(39) + '; ' + chr(39), 'nth')}, case when max(n) > {limit} then concat(' (+', cast(max(n) - {limit} as string), ' more)') else '' end) as section from h1 where nth <= {limit} group by doc_id, chunk, grp"),
    )


class on(staged):
    """A query over the turns; those and the events are read by several steps."""

    CUTS = ("y", "z")

    def __init__(self, *more, select):
        super().__init__(turns, *more, select=select)


def speech(d):
    """Conversations as one text each, a speaker and a message a line."""
    return (
        ("c0", f"select conv_id, turn, case when role = 'user' then '> ' when role = 'assistant' then '⏺ ' else '' end as mark, {d.sub('coalesce(text, ' + chr(39) * 2 + ')', r'\n+', chr(10))} as text from conversations"),
        ("c1", f"select conv_id, {d.agg_join('concat(mark, text)', 'concat(chr(10), chr(10))', 'turn')} as text from c0 group by conv_id"),
        ("c2", d.explode("c1", "conv_id", d.split("text", r"\n"), "line_no", "line")),
        ("c3", f"select *, {r.trim(d, 'line')} as t from c2"),
        ("c4", "select *, case when t like '⏺%' or t like '>%' then 1 else 0 end as marked, case when t = '' then 1 else 0 end as blank from c3"),
        ("c5", "select *, sum(marked + blank) over (partition by conv_id order by line_no rows between unbounded preceding and current row) as grp from c4"),
        ("c6", "select *, max(marked) over (partition by conv_id, grp) as spoken from c5 where blank = 0"),
        ("c7", f"select conv_id, min(line_no) as line_no, concat(case when min(t) like '>%' or max(case when marked = 1 then t end) like '>%' then 'USER: ' else 'AGENT: ' end, {d.agg_join(r.trim(d, d.sub('t', '^(⏺|>)', '')), chr(39) + ' ' + chr(39), 'line_no')}) as message from c6 where spoken = 1 group by conv_id, grp union all select conv_id, line_no, concat('LOG: ', t) as message from c6 where spoken = 0"),
        ("c", "select conv_id, line_no, message, cast(row_number() over (partition by conv_id order by line_no) as bigint) as nth from c7"),
    )


def exported(d):
    user = r.trim(d, d.sub("coalesce(request_message, '')", r"(?s)\{.*?\}", ""))
    agent = r.trim(d, d.sub("coalesce(response_text, '')", r"(?s)\{.*?\}", ""))
    if d.name == "spark":
        made = "select conv_id, to_json(named_struct('version', '1', 'conversation', named_struct('chatHistory', transform(sort_array(collect_list(struct(turn, role, text))), x -> named_struct('chatItemType', 'exchange', 'request_message', if(x.role = 'user', x.text, ''), 'response_text', if(x.role = 'assistant', x.text, '')))))) as doc from conversations group by conv_id"
        read = "select conv_id, cast(pos as bigint) as pos, col.request_message, col.response_text from (select conv_id, from_json(doc, 'version string, conversation struct<chatHistory: array<struct<chatItemType: string, request_message: string, response_text: string>>>') as j from j0) lateral view posexplode(j.conversation.chatHistory) as pos, col where col.chatItemType <> 'agentic-checkpoint-delimiter'"
        steps = (("j0", made), ("j1", read))
    else:
        steps = (("j1", "select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as pos, case when role = 'user' then text else '' end as request_message, case when role = 'assistant' then text else '' end as response_text from conversations"),)
    return (*steps, ("j2", f"select conv_id, pos, {r.trim(d, 'concat(' + chr(39) + 'USER: ' + chr(39) + ', ' + user + ', chr(10), ' + chr(39) + 'AGENT: ' + chr(39) + ', ' + agent + ')')} as part from j1"))


QUERIES = {
    "recap_relevance": on(select="select doc_id, idx, score, n_files from y"),
    "recap_event_type": on(select="select doc_id, idx, kind, intent from y"),
    "recap_events": on(events, select="select doc_id, idx, kind, intent, summary from z"),
    "recap_briefing": on(briefing, select="select doc_id, idx, body as summary, nth from br where nth <= 3"),
    "recap_last_turns": on(select="select doc_id, max(case when raw like 'USER:%' then idx end) as last_user, max(case when raw like 'AGENT:%' then idx end) as last_agent from y group by doc_id"),
    "recap_command_dedupe": on(events, select="select doc_id, intent, cast(count(*) as bigint) as n, cast(sum(case when copy = 1 then 1 else 0 end) as bigint) as n_distinct from z2 group by doc_id, intent"),
    "recap_timeline": on(events, timeline, select="select doc_id, place, idx, kind, intent, summary from o"),
    "recap_chunks_by_count": on(events, timeline, chunks, select="select doc_id, chunk, cast(count(*) as bigint) as n_events, cast(sum(length(summary)) as bigint) as n_chars from ch group by doc_id, chunk"),
    "recap_chunk_groups": on(events, timeline, chunks, sections, select="select doc_id, chunk, grp, n, section from h"),
    "recap_highlights": on(events, timeline, chunks, select="select doc_id, grp, cast(count(*) as bigint) as n, cast(count(distinct summary) as bigint) as n_distinct from ch where grp <> 'error' group by doc_id, grp"),
    "recap_problems": on(events, select="select doc_id, nth, summary, status from (select doc_id, summary, 'pending' as status, cast(row_number() over (partition by doc_id order by idx) as bigint) as nth from z where kind = 'error') t where nth <= 6"),
    "render_recap": on(events, timeline, chunks, sections, select=lambda d: f"select doc_id, {d.agg_join('block', 'concat(chr(10), chr(10))', 'chunk')} as recap from (select doc_id, chunk, concat('### Block ', cast(chunk + 1 as string), chr(10), {d.agg_join('section', 'chr(10)', 'sort_key')}) as block from h group by doc_id, chunk) t group by doc_id"),
    "transcript_parse": lambda d: query(*speech(d), ("", "select conv_id, nth, message from c where nth <= 2000")),
    "chat_json_parse": lambda d: query(*exported(d), ("", f"select conv_id, {d.agg_join('part', 'concat(chr(10), chr(10))', 'pos')} as text from j2 where length(part) > 10 group by conv_id")),
}


def _whole(*more):
    """The registered select of a query over the whole timeline."""
    limit = lambda d: timeline(d)[:1]
    return lambda select: on(events, briefing, errors, limit, whole_timeline, *more, select=select)


# Run by Spark in place of the definition of that name, which holds the events alone; recap_timeline_whole is beside recap_timeline.
WHOLE = {
    "recap_timeline_whole": _whole()("select doc_id, place, idx, kind, intent, summary from o"),
    "recap_chunks_by_count": _whole(whole_chunks)("select doc_id, chunk, cast(count(*) as bigint) as n_events, cast(sum(length(summary)) as bigint) as n_chars from ch group by doc_id, chunk"),
    "recap_chunk_groups": _whole(whole_chunks, sections)("select doc_id, chunk, grp, n, section from h"),
    "recap_highlights": _whole(whole_chunks)("select doc_id, grp, cast(count(*) as bigint) as n, cast(count(distinct summary) as bigint) as n_distinct from ch where grp <> 'error' group by doc_id, grp"),
    "render_recap": _whole(whole_chunks, sections)(lambda d: f"select doc_id, {d.agg_join('block', 'concat(chr(10), chr(10))', 'chunk')} as recap from (select doc_id, chunk, concat('### Block ', cast(chunk + 1 as string), chr(10), {d.agg_join('section', 'chr(10)', 'sort_key')}) as block from h group by doc_id, chunk) t group by doc_id"),
}
