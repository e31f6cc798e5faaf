"""Chat formatting: heterogeneous layouts to canonical turns by schema fingerprints, and a template that reads back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import ship, table

#: Template: a line "<turn> role", the text, and a line "</turn>". Turns under the loss mask are the assistant's.
BEGIN, END, MARK = "<turn> ", "</turn>", "\\"
ASSISTANT = "assistant"
#: Names of roles in other layouts, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str]) -> str:
    """Hash of the set of nested field paths; [] marks an array's elements."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    return [at]


def value_paths(value: object, at: str = "") -> list[str]:
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in value_paths(v, f"{at}.{k.lower()}" if at else k.lower())] or [at]
    if isinstance(value, list):
        return [p for v in value for p in value_paths(v, f"{at}[]")] or [f"{at}[]"]
    return [at]


#: Declarative mappings: the fields of a layout, then where its turns come from. A list field gives a turn for each
#: element (role field, text field); otherwise each entry is (role, fields joined by a blank line).
LAYOUTS: list[tuple[list[str], dict]] = [
    (["messages[].role", "messages[].content"], {"list": ("messages", "role", "content")}),
    (["conversations[].from", "conversations[].value"], {"list": ("conversations", "from", "value")}),
    (["turns[].role", "turns[].text"], {"list": ("turns", "role", "text")}),
    (["prompt", "response"], {"fields": [("user", ["prompt"]), ("assistant", ["response"])]}),
    (["prompt", "completion"], {"fields": [("user", ["prompt"]), ("assistant", ["completion"])]}),
    (["system", "prompt", "response"], {"fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]}),
    (["question", "answer"], {"fields": [("user", ["question"]), ("assistant", ["answer"])]}),
    (["instruction", "output"], {"fields": [("user", ["instruction"]), ("assistant", ["output"])]}),
    (["instruction", "input", "output"], {"fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    (["conv_id", "turn", "role", "text"], {"rows": ("conv_id", "turn", "role", "text")}),
]
MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}
_FIELDS = {p.split("[")[0] for paths, _ in LAYOUTS for p in paths}


def mapping_of(schema: T.StructType) -> dict:
    """The mapping for a frame's schema. Columns that no layout has are left out of the fingerprint first."""
    known = T.StructType([f for f in schema.fields if f.name.lower() in _FIELDS])
    paths = schema_paths(known)
    found = MAPPINGS.get(fingerprint(paths))
    if found is None:
        lists = [(p, m) for p, m in LAYOUTS if "rows" not in m and set(p) <= set(paths)]
        rows = [(p, m) for p, m in LAYOUTS if "rows" in m and set(p) <= set(paths)]
        if not lists + rows:
            raise ValueError(f"no chat layout has the fields {sorted(paths)}")
        found = max(rows + lists, key=lambda x: len(x[0]))[1]
    return found


def _role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(known[role], role, F.lit(""))


def to_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation: key and turns (array of role, text), whatever the layout.

    Layouts with a row for each turn are grouped by the key and ordered by turn (nulls first, then role, then text), with
    their roles as they are; a conversation has to fit into a row anyway. Lists get canonical roles by `ROLES`. In the other layouts a row is a conversation; empty optional fields make
    no turn. Null texts and roles are empty. Repeated rows are kept: repeated turns in the first case, repeated
    conversations in the second.
    """
    mapping = mapping_of(df.schema)
    if "rows" in mapping:
        conv, turn, role, text = mapping["rows"]
        one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        held = df.groupBy(F.col(conv).alias(key)).agg(F.sort_array(F.collect_list(one)).alias("turns"))
        return held.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    if "list" in mapping:
        name, role, text = mapping["list"]
        turns = F.transform(F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)), lambda t: F.struct(_role(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
        return df.select(F.col(key), turns.alias("turns"))
    entries = []
    for role, fields in mapping["fields"]:
        parts = F.filter(F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields)), lambda x: x != "")
        entries.append(F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    turns = F.filter(F.array(*entries), lambda t: (t["role"] != "system") | (t["text"] != ""))
    return df.select(F.col(key), turns.alias("turns"))


def _said(value: object) -> str:
    """A field's text: none for null, JSON for what isn't text; halves of surrogate pairs become question marks."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


def record_turns(record: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Fingerprint and canonical turns of a JSON record of any known layout; unknown or broken ones give no turns.

    Names of fields have any case. Numbers and other values that aren't text are taken as they stand in the JSON.
    """

    def lowered(pairs: list[tuple[str, object]]) -> dict:
        return {k.lower(): v for k, v in pairs}

    try:
        value = json.loads(record or "null", object_pairs_hook=lowered)
    except (ValueError, RecursionError):
        return "", []
    if not isinstance(value, dict):
        return "", []
    value = {k: v for k, v in value.items() if k in _FIELDS - {"conv_id", "turn"} and v is not None}
    shape = fingerprint(value_paths(value))
    mapping = MAPPINGS.get(shape, {})
    if "list" in mapping:
        name, role, text = mapping["list"]
        return shape, [(ROLES.get(r := _said(t.get(role)), r), _said(t.get(text))) for t in value[name]]
    turns = [(role, "\n\n".join(x for f in fields if (x := _said(value.get(f))))) for role, fields in mapping.get("fields", [])]
    return shape, [t for t in turns if t[0] != "system" or t[1]]


def records_to_turns(df: DataFrame, key: str, record: str) -> DataFrame:
    """key, layout fingerprint and turns of rows that hold JSON records, each of its own layout."""
    ship(df.sparkSession)
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("layout", T.StringType()), T.StructField("turns", T.ArrayType(turn))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [record_turns(x) for x in batch.column(1).to_pylist()]
            turns = pa.array([[{"role": r, "text": t} for r, t in x[1]] for x in found], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), turns], schema.names)

    return df.select(F.col(key).alias("key"), F.col(record).alias("record")).mapInArrow(run, schema)


def _escaped(text: Column) -> Column:
    """Reversible: every line that begins with a mark of the template, after any backslashes, gets one backslash more.
    Newlines are kept; a line break in a role would end it, so it is written as a mark of its own."""
    return F.regexp_replace(text, r"(?<![^\n])(?=\\*</?turn>)", r"\\")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def format_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Render turns: key, formatted, and loss_spans (begin and end code points of each assistant text in it).

    A conversation without turns gives an empty string and no spans.
    """
    opened = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(BEGIN), _escaped_role(t["role"]), F.lit("\n")).alias("head"), _escaped(t["text"]).alias("body")))
    tail = len(END) + 2

    def put(state: Column, t: Column) -> Column:
        begin = state["n"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))
        spans = F.when(t["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + tail).alias("n"), spans.alias("spans"))

    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    spans = F.aggregate("opened", F.struct(F.lit(0).alias("n"), empty.alias("spans")), put)["spans"]
    text = F.array_join(F.transform("opened", lambda t: F.concat(t["head"], t["body"], F.lit(f"\n{END}\n"))), "")
    return df.select(F.col(key), opened.alias("opened")).select(key, text.alias("formatted"), spans.alias("loss_spans"))


_UNESCAPE = re.compile(r"(?<![^\n])\\(?=\\*</?turn>)")
_BACK = {"\\\\": "\\", "\\n": "\n", "\\r": "\r"}


def unescape(body: str) -> str:
    return _UNESCAPE.sub("", body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of the template."""
    turns = []
    for part in formatted.split(f"\n{END}\n")[:-1]:
        head, _, body = part.partition("\n")
        turns.append((re.sub(r"\\[\\nr]", lambda m: _BACK[m[0]], head.removeprefix(BEGIN)), unescape(body)))
    return turns


def digests(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted strings say, read back from them: turns, and the text under the loss mask."""
    ship(df.sparkSession)
    columns = [(key, df.schema[key].dataType), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([T.StructField(*x) for x in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            made = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], schema.names)

    return df.select(F.col(key).alias("key"), "formatted", "loss_spans").mapInArrow(run, schema)


#: A turn that looks like the template's own marks.
MARKED = r"\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of number -7, read back from their formatted strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], rows.schema)
    return digests(format_turns(to_turns(rows.unionByName(more))))


ORACLE_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'),
sized AS (
  SELECT *, length(text) + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\*</?turn>'))) AS body,
    length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), chr(13), '\r')) AS head FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  CAST(sum({len(BEGIN)} + head + 1 + body + {len(END) + 2}) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
