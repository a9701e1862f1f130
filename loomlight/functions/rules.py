"""Scalar rules for log lines and turns, as SQL expressions over an expression.

Each takes a dialect and the SQL of a line. `columns` wraps them as Column functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK

# Patterns, weights and categories of the line model.
NOISE = r"(?i)(heartbeat|healthcheck|debug)"
STORY = r"(?i)^#?\d+(?:\.o|\.|\))\s+.+"
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HEX = r"(?i)\b[0-9a-f]{16,}\b"
JWT = r"eyJ[\w-]+\.[\w-]+\.[\w-]+"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
API_KEY = r"\b[A-Za-z0-9]{32,}\b"
CONTEXT = r"(?i)(Form .* changed|submitChanges|Updating FlowVersion|Error:|\[Error|Console)"
CATEGORIES = (
    ("Authentication", r"(?i)(auth|oauth|token|login|unauthorized|forbidden|credential)"),
    ("Network", r"(?i)(timeout|network|ECONN|fetch failed|DNS|socket|connection)"),
    ("Performance", r"(?i)(Violation|took \d+ms|performance|slow script|long task)"),
    ("Database", r"(?i)(database|postgres|mongo|sql|prisma|query failed)"),
    ("Rate Limit", r"(?i)(rate limit|too many requests|429)"),
    ("Error", r"(?i)(error|exception|failed|unhandled rejection)"),
    ("Story", STORY),
)
MESSAGES = (
    (r"(?i)(error|fail|exception|timed out|denied)", 3),
    (r"(?i)\[.*?ERROR.*?\]", 3),
    (r"(?i)(warn|deprecated)", 1),
    (r"(?i)\b(WORKFLOW_|EditorClient)\b", 1),
    (r"(?i)(authentication|unauthorized|permission)", 1),
    (r"(?i)access granted", -2),
    (r"(?i)(CORS|allowing empty origin|matchesPattern: false|Connection claim succeeded|claim succeeded|check-claim)", -3),
)
STATUS = {"2": -1, "4": 2, "5": 4}
STATUS_EXACT = {"401": 3, "403": 3, "404": 3}
LATENCY = ((500, 1), (1000, 2), (5000, 3))
ACCENT = r"(?i)[áàâãéêíîóôõúçÁÀÂÃÉÊÍÎÓÔÕÚÇ]"
FIRST_PERSON = r"(?i)\b(eu|minha|minhas|meu|meus|nossa|nosso|gente)\b"
HTTP_START = r"(?i)^(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s"
STATUS_NUMBER = r"\b[1-5]\d{2}\b"
FRAME = r"(^(at\s|\s+at\s|\s*@|react_stack_bottom_frame|runWithFiberInDEV)| @ |react-dom_client|next@|webpack-internal|node:)"
BOUNDARY = (r"^\d{4}-\d{2}-\d{2}", r"^[A-Za-z0-9_.-]+:\d+", r"^\[[^\]]+\]", r"\b(Error|Exception|Warning|WARN|INFO|DEBUG|TRACE)\b", r"^(GET|POST|PUT|DELETE|PATCH)\s")
NO_STATUS_PENALTY = r"(?i)(error|fail|exception|aborted|timeout|denied|reset)"


def trim(d, e):
    return d.sub(e, r"^\s+|\s+$", "")


def noise(d, e):
    return f"({d.match(e, NOISE)} and not {d.match(e, STORY)})"


def redact(d, e):
    for p, r in ((JWT, "{JWT}"), (HEX, "{HEX}"), (API_KEY, "{API_KEY}")):
        e = d.sub(e, p, r)
    return e


def latency_words(d, e):
    """` in Nms` by range; the range follows from the digits, so that five rewrites do."""
    e = d.sub(e, r" in 0*([2-9]\d|[1-9]\d{2,})\d{3}ms", r" in (CRITICAL >\1s)")
    e = d.sub(e, r" in 0*1\d{4}ms", " in (VERY SLOW >10s)")
    e = d.sub(e, r" in 0*[5-9]\d{3}ms", " in (SLOW)")
    e = d.sub(e, r" in 0*[1-4]\d{3}ms", " in (~sec)")
    return d.sub(e, r" in \d{1,}ms", " in (fast)")


def latency_bucket(ms):
    return f"case when {ms} < 1000 then 'fast' when {ms} < 5000 then '~sec' when {ms} < 10000 then 'SLOW' when {ms} < 20000 then 'VERY SLOW >10s' else concat('CRITICAL >', cast(cast(floor({ms} / 1000) as bigint) as string), 's') end"


def normalize(d, e):
    e = latency_words(d, e)
    for p, r in ((r"\?v=[\w-]+", "?v=VERSION"), (r"(?i)(token|authorization)=([A-Za-z0-9._-]+)", r"\1={TOKEN}"), (r"flowId: [\w-]+", "flowId: ID"), (r"tenantId: [\w-]+", "tenantId: ID"), (r"flowVersionId: [\w-]+", "flowVersionId: ID"), (r"timestamp: \d+", "timestamp: TIMESTAMP")):
        e = d.sub(e, p, r)
    for p, r in ((TIMESTAMP, "TIMESTAMP"), (UUID, "UUID"), (IP, "IP")):
        e = d.sub1(e, p, r)
    e = d.sub(e, HEX, "HEX")
    e = d.sub1(e, r"(?i)(pid|processId|process_id)=([0-9]+)", r"\1=ID")
    e = d.sub(e, r"(?i)user[:=]\s*\w+", "user=USER")
    e = d.sub(e, r"(?i)session[:=]\s*\w+", "session=SESSION")
    e = d.sub1(e, r"[A-Za-z]+Error:", "ERROR:")
    for p, r in ((EMAIL, "EMAIL"), (JWT, "TOKEN"), (r"\b\d+\b", "NUMBER")):
        e = d.sub(e, p, r)
    return e


def placeholders(d, e):
    return d.sub(e, r"(?i)id=[0-9a-f-]+", "{ID}")


def placeholder_values(d, e):
    return d.findall(e, r"(?i)id=([0-9a-f-]+)", 1)


def structural(d, normalized):
    """Structural signature of a normalized line."""
    return trim(d, d.sub(d.sub(normalized, r"[A-Za-z0-9_]+", "X"), r"\s+", " "))


def words_in(d, e):
    return d.size(d.split(trim(d, e), r"\s+"))


def human_note(d, e):
    t = trim(d, e)
    return f"({t} <> '' and ({d.match(t, ACCENT)} or {d.match(t, FIRST_PERSON)} or {words_in(d, e)} >= 5) and not {d.match(t, HTTP_START)} and not {d.match(t, STATUS_NUMBER)})"


def status(d, e):
    return d.find(e, r"\b([1-5]\d{2})\b", 1)


def line_score(d, e):
    code = status(d, e)
    exact = " ".join(f"when {code} = '{c}' then {w}" for c, w in STATUS_EXACT.items())
    series = " ".join(f"when substr({code}, 1, 1) = '{c}' then {w}" for c, w in STATUS.items())
    ms = d.find(e, r"(?i)\b(\d+)ms\b", 1)
    parts = [f"case {exact} {series} else 0 end", f"case when substr({code}, 1, 1) = '2' and not {d.match(e, NO_STATUS_PENALTY)} then -2 else 0 end"]
    parts += [f"case when {ms} <> '' and cast(concat('0', {ms}) as double) >= {m} then {w} else 0 end" for m, w in LATENCY]
    parts += [f"case when {d.match(e, p)} then {w} else 0 end" for p, w in MESSAGES]
    parts.append(f"case when {human_note(d, e)} then 2 else 0 end")
    return f"cast(case when {d.match(e, STORY)} then 100 else {' + '.join(parts)} end as bigint)"


def category(d, e):
    return "case " + " ".join(f"when {d.match(e, p)} then '{name}'" for name, p in CATEGORIES) + " else 'Other' end"


def boundary(d, e):
    """Whether a line that is not the first starts an event."""
    t = trim(d, e)
    return "(" + " or ".join([f"{t} = ''", d.match(t, STORY), *(d.match(t, p) for p in BOUNDARY)]) + ")"


def error_normal(d, e):
    for p, r in ((r"/[^/]*/", "[PATH]"), (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "[TIME]"), (r":\d+", ":LINE")):
        e = d.sub(e, p, r)
    return f"lower({e})"


def error_hash(d, e):
    """31-polynomial 32-bit hash, absolute value, base 36."""
    codes = d.map(d.chars(e), d.code("x"))
    h = d.fold(codes, "cast(0 as bigint)", "(acc * 31 + x) % 4294967296")
    return d.base36(f"least({h}, 4294967296 - {h})")


def columns():
    """The rules as functions of a column name or SQL expression, for DataFrame code."""
    def wrap(rule):
        def function(e: str) -> Column:
            return F.expr(rule(SPARK, e))

        function.__name__ = rule.__name__
        function.__doc__ = rule.__doc__ or f"Column of the rule {rule.__name__}."
        return function

    return {r.__name__: wrap(r) for r in (trim, noise, redact, latency_words, normalize, placeholders, placeholder_values, structural, human_note, status, line_score, category, boundary, error_normal, error_hash)}
