"""Transcript turns: types, segmentation, density, TF-IDF, transitions, selection."""

from __future__ import annotations

from ..functions import rules as r
from .logs import lines, query

# Ordered rules of the turn type.
ACTION_MARK = r"(?i)^(?:•|→)?\s*(?:Added|Edited|Deleted|Updated|Created|Modified|Removed|Ran|Executed|Implemented|Built|Compiled|Installed|Saved|Wrote|Read|Called|Sent|Received|Connected|Disconnected|Started|Stopped)"
BULLET_MODEL = r"(?i)^(?:•|→)?\s*(?:I\x27ll|I can|Here\x27s|The code|Let me|This will|You can|To solve|Based on|I need|I\x27m|I am|That|Yes|No|Okay|Alright|Sure|Of course)|(?:function|class|const|let|var|return|import|export|analyze|understand|explain|implement|create|generate|provide)|^(?:•|→)?\s*(?:Explored|Ran|Executed|Updated|Modified|Changed|Working|Planning|Thinking|Considering|Looking|Found|See|Need|Should|Will|Going|Want|Like|Think|Know|Have|Make|Do|Can|Could)"
RESULT = r"(?i)^(?:\s+└|[├─]|>>>|\$|#|\[|\{)|^(?:total\s+\d+|drwxr|lrwxr|-rw|bash:|└\s+)"
USER = r"(?i)\?$|(?:implement|create|add|remove|update|fix|change|modify|generate|build|write|read|analyze|review|check|verify|test)|^@\w+|(?:please|can you|could you|i need|i want|make|help|show|tell me)|^(?:Run|Execute|Install|Setup|Configure)"
MODEL = r"(?i)^(?:I\x27ll|I can|Here\x27s|The code|Let me|This will|You can|To solve|Based on|I am|I\x27m|That|Yes|No|Okay|Alright|Sure|Of course|Explored|Working|Planning|Looking|Found)|(?:function|class|const|let|var|return|import|export|understand|explain|provide|consider|think|believe|see|need|should|will|going|want|like|know|have|do|can|could)"
DECISION = r"(?i)(?:must|plan to|next|milestone|decided|decision|choose|select)"
ERROR = r"(?i)(?:error|failed|exception|blocker|⚠|❌|warn)"
ANALYSIS = r"(?i)(?:analyzing|analysis|wondering|noticing|realizing|comprehending)|^(?:I wonder|It seems|It looks|It appears|The issue|The problem)"
SEPARATOR = r"^─{3,}|^===+|^---+|^###|^##\s"
CODE = r"(?i)[{}()\[\]<>]|:=|=>|const|function|class|return|import|export"
VERB = r"(?i)^(?:Added|Edited|Deleted|Created|Updated|Running|Executed|Implemented)"
WEIGHTS = {"action": 1.0, "error": 0.95, "user_request": 0.85, "model_response": 0.8, "decision": 0.9, "analysis": 0.5, "thought": 0.3, "result": 0.6}
STOP_WORDS = "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might can as if then so because while during before after de la le les et ou que qui où comment o os e um uma uns umas".split()


def turn_type(d, e):
    t = r.trim(d, e)
    cases = (
        (f"{t} = ''", "null"),
        (d.match(t, r"(?i)^##\s*(User|Human)\s*$"), "'user_request'"),
        (d.match(t, r"(?i)^##\s*(Assistant|AI|Model)\s*$"), "'model_response'"),
        (d.match(t, "^›"), "'user_request'"),
        (f"{d.match(t, '^•')} and {d.match(t, ACTION_MARK)}", "'action'"),
        (f"{d.match(t, '^•')} and {d.match(t, BULLET_MODEL)}", "'model_response'"),
        (d.match(t, "^•"), "'thought'"),
        (d.match(t, RESULT), "'result'"),
        (d.match(t, USER), "'user_request'"),
        (d.match(t, MODEL), "'model_response'"),
        (d.match(t, DECISION), "'decision'"),
        (d.match(t, ERROR), "'error'"),
        (d.match(t, ANALYSIS), "'analysis'"),
    )
    return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + " end"


def density(d, e):
    """Null for a text without a word of three characters."""
    words = d.filter(d.split(f"lower({e})", r"\s+"), "length(x) > 2")
    n, u = f"cast({d.size(words)} as double)", f"cast({d.size(d.distinct_sorted(words))} as double)"
    s = d.filter(d.split(e, r"[.!?]+"), f"{r.trim(d, 'x')} <> ''")
    mean = f"({n} / greatest(1.0, cast({d.size(s)} as double)))"
    return f"case when {r.trim(d, e)} = '' then cast(0 as double) when {n} = 0 then null else round(0.4 * {u} / {n} + 0.4 * least(1.0, {mean} / 15) + 0.2 * least(1.0, ({u} - {mean}) / {n}), 6) end"


def segmented(d):
    last = "last(type, true)" if d.name == "spark" else "last_value(type ignore nulls)"
    return (
        ("t0", f"select doc_id, line_no, line, {turn_type(d, 'line')} as type, case when line_no > 0 and {d.match(r.trim(d, 'line'), SEPARATOR)} then 1 else 0 end as sep from l"),
        ("t1", "select *, sum(sep) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as seg from t0"),
        ("t2", f"select *, {last} over (partition by doc_id, seg order by line_no rows between unbounded preceding and 1 preceding) as prev from t1"),
        ("t3", "select *, case when line_no > 0 and (sep = 1 or (type is not null and prev is not null and type <> prev)) then 1 else 0 end as starts from t2"),
        ("t4", "select *, sum(starts) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as turn from t3"),
        ("t5", f"select doc_id, cast(turn as bigint) as turn_idx, min(line_no) as start_line, cast(count(*) as bigint) as line_count, {'max_by(type, case when type is not null then line_no end)' if d.name == 'spark' else 'arg_max(type, case when type is not null then line_no end)'} as type, {d.agg_join('line', 'chr(10)', 'line_no')} as text from t4 group by doc_id, turn"),
        ("t", f"select *, cast(length(text) as bigint) as n_chars, {d.size(d.split('text', r'[\s]+'))} as word_count, {r.trim(d, 'text')} = '' as is_empty, {density(d, 'text')} as density, {d.match('text', CODE)} as has_code, {d.match('text', VERB)} as has_action_verb from t5"),
    )


def upto(d):
    return (lines(d), *segmented(d))


def terms(d):
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (
        ("w0", d.explode("t", "doc_id, turn_idx", d.filter(d.split("lower(text)", "[^a-z0-9_]+"), f"length(x) > 2 and x not in ({stop})"), "i", "term")),
        ("w1", "select doc_id, turn_idx, term, cast(count(*) as double) as n from w0 group by doc_id, turn_idx, term"),
        ("w2", "select *, count(*) over (partition by doc_id, term) as df, sum(n) over (partition by doc_id, turn_idx) as len from w1"),
        ("w3", "select doc_id, cast(count(*) as double) as turns from t group by doc_id"),
        ("w4", "select w2.doc_id, turn_idx, sum(n * n * ln(turns / df)) / (max(len) * max(len)) as score, max(len) as n_terms from w2 join w3 on w2.doc_id = w3.doc_id group by w2.doc_id, turn_idx"),
        ("tf", "select t.*, round(coalesce(score, 0.0), 6) as tfidf, cast(coalesce(n_terms, 0) as bigint) as n_terms from t left join w4 on t.doc_id = w4.doc_id and t.turn_idx = w4.turn_idx"),
    )


def weighted(d):
    case = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items())
    return (
        ("sc", f"select *, round(tfidf * 0.4 + density * 0.4 + 0.2 * case type {case} else 0.4 end, 5) as score from tf"),
        ("se", "select *, coalesce(type in ('action', 'error', 'decision', 'user_request', 'model_response'), false) or coalesce(score >= 0.25, false) as selected from sc"),
    )


def following(d):
    over = "over (partition by doc_id order by turn_idx)"
    return (("n", f"select *, lead(turn_idx) {over} as next_idx, lead(type) {over} as next_type, lead(density) {over} as next_density, lead(has_code) {over} as next_code, lead(has_action_verb) {over} as next_verb from t"),)


def on(*more, select):
    return lambda d: query(*upto(d), *(s for m in more for s in m(d)), ("", select(d) if callable(select) else select))


QUERIES = {
    "turn_type_lines": lambda d: query(lines(d), ("", f"select doc_id, line_no, {turn_type(d, 'line')} as type from l")),
    "turns_segment": on(select="select doc_id, turn_idx, start_line, line_count, type, text from t"),
    "turn_density": on(select="select doc_id, turn_idx, density from t"),
    "turn_features": on(select="select doc_id, turn_idx, n_chars, word_count, line_count, is_empty, has_code, has_action_verb from t"),
    "turn_type_mix": on(select="select doc_id, coalesce(type, 'null') as type, cast(count(*) as bigint) as n from t group by 1, 2"),
    "turn_primary_type": on(select=lambda d: "select doc_id, type, n from (select *, row_number() over (partition by doc_id order by n desc, first_idx) as rank from (select doc_id, coalesce(type, 'null') as type, cast(count(*) as bigint) as n, min(turn_idx) as first_idx from t group by 1, 2) a) b where rank = 1"),
    "turn_transitions": on(following, select="select doc_id, turn_idx, next_idx, coalesce(type, '') <> coalesce(next_type, '') as type_changed, cast(abs(cast(round(density * 1000000) as bigint) - cast(round(next_density * 1000000) as bigint)) as double) / 1000000 as density_change, cast(case when coalesce(type, '') <> coalesce(next_type, '') then 5000000 else 0 end + 3 * abs(cast(round(density * 1000000) as bigint) - cast(round(next_density * 1000000) as bigint)) + case when has_code <> next_code then 1000000 else 0 end + case when has_action_verb <> next_verb then 1000000 else 0 end as double) / 10000000 as change from n where next_idx is not null"),
    "turn_boundaries": on(
        following,
        select="select doc_id, turn_idx, concat('type_change: ', type, ' → ', next_type) as reason, 'high' as importance from n where type is not null and next_type is not null and type <> next_type"
        " union all select doc_id, turn_idx, 'density_jump' as reason, 'medium' as importance from n where abs(density - next_density) > 0.5"
        " union all select doc_id, turn_idx, 'context_change: code/action transition' as reason, 'high' as importance from n where has_code <> next_code and has_action_verb <> next_verb",
    ),
    "turn_tfidf": on(terms, select="select doc_id, turn_idx, tfidf, n_terms from tf"),
    "turn_select": on(terms, weighted, select="select doc_id, turn_idx, type, score from se where selected"),
    "turn_insights": on(
        terms,
        weighted,
        select="select doc_id, cast(count(*) as bigint) as n_turns, cast(sum(case when selected then 1 else 0 end) as bigint) as n_selected, round(min(density), 6) as min_density, round(max(density), 6) as max_density, round(avg(density), 5) as mean_density, round(avg(cast(n_chars as double)), 5) as mean_chars, cast(sum(case when has_code then 1 else 0 end) as bigint) as n_code, cast(sum(case when has_action_verb then 1 else 0 end) as bigint) as n_verbs from se group by doc_id",
    ),
}
