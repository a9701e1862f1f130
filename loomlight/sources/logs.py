"""Log lines: derived from the events table, or read from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of every kind the rules know, by a CASE that both engines read alike.
_LINE = r"""case
 when line_no % 29 = 0 then concat(cast(n % 9 + 1 as string), '. User opens the form and saves it ', cast(n % 5 as string))
 when line_no % 23 between 10 and 15 then concat('    at handler', cast(line_no % 23 as string), ' (node:internal/app.js:', cast(n % 90 as string), ':10)')
 when line_no % 31 = 7 then ''
 when line_no % 37 = 5 then concat('DEBUG heartbeat ok ', cast(n as string))
 when event_type = 'error' and n % 4 = 0 then concat('[ERROR] Error: request failed user: ', cast(u as string), ' in ', cast(ms as string), 'ms status 500')
 when event_type = 'error' and n % 4 = 1 then concat('2024-01-02T03:04:', cast(10 + n % 50 as string), 'Z TypeError: cannot read flowId: ab-', cast(n % 7 as string), ' pid=', cast(n as string), ' at src/core/flow', cast(n % 3 as string), '.ts')
 when event_type = 'error' and n % 4 = 2 then concat('ConnectionError: connection refused from 10.0.0.', cast(n % 250 as string), ' to 10.0.1.', cast(n % 99 as string), ' failed after 3 tries')
 when event_type = 'error' then concat('postgres query failed: exception: relation t', cast(n % 6 as string), ' is missing')
 when event_type = 'click' and n % 3 = 0 then concat('GET /api/items/', cast(n % 40 as string), '?v=1-', cast(n % 8 as string), ' 200 in ', cast(ms as string), 'ms')
 when event_type = 'click' and n % 3 = 1 then concat('POST /api/login?token=abc', cast(n as string), ' 401 in ', cast(ms * 3 as string), 'ms')
 when event_type = 'click' then concat('index.tsx:', cast(200 + n % 50 as string), ' [StepSettings] Form sheetId changed id=', cast(n % 9 as string), 'a-', cast(n % 4 as string))
 when event_type = 'signup' and n % 2 = 0 then concat('INFO signup mail user', cast(u as string), '@example.com session: s', cast(n as string), ' Created docs/plan', cast(n % 4 as string), '.md')
 when event_type = 'signup' and n % 4 = 1 then concat('Milestone: ship part ', cast(n % 6 as string), ' of the editor, phase BETA0', cast(n % 3 as string), ': done')
 when event_type = 'signup' then concat('Decision: we should keep the plan for phase ', cast(n % 5 as string), ' and its tests')
 when event_type = 'view' and n % 3 = 0 then concat('WARN slow script took ', cast(ms * 7 as string), 'ms on https://example.com/p', cast(n % 6 as string))
 when event_type = 'view' and n % 3 = 1 then concat('key eyJhbGci', cast(n as string), '.eyJzdWIi.c2ln and 0123456789abcdef', cast(n % 10 as string), ' user=', cast(u as string))
 when event_type = 'view' then concat('Updated src/pages/view', cast(n % 5 as string), '.svelte and fixed lib/util.js, next we will run tests')
 when n % 2 = 0 then concat('purchase done in ', cast(ms * 2 as string), 'ms id=', cast(n % 11 as string), '-ff timestamp: ', cast(n as string))
 else concat('GET /api/cart 200 in 35ms ref ', cast(n % 3 as string)) end"""

LINES = f"""select doc_id, line_no, {_LINE} as line from (
 select user_id as doc_id, user_id as u, event_id as n, event_type, cast(floor(value * 40) as bigint) as ms,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as line_no from events)"""


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_name, text) of whole text files."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_name"), F.col("value").alias("text"))
    return d.select(F.xxhash64("file_name").alias("doc_id"), "file_name", "text")


def split_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line)."""
    return documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), r"\r?\n", -1)).alias("line_no", "line"))


def joined_upload(documents: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """One text of all files in name order, with a header before each when there are several."""
    d = documents.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("name"), F.col(text).alias("text")))).alias("f"))
    parts = "transform(f, (x, i) -> concat('---- Document ', lpad(cast(i + 1 as string), 2, '0'), ' (', x.name, ') ----\\n', x.text))"
    return d.select(F.expr(f"if(size(f) = 1, f[0].text, array_join({parts}, '\\n'))").alias("text"))
