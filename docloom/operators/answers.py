"""Structured answers: schemas closed for strict use, schemas of tables, and plans read from answers with what is malformed told apart."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import CONTROL

#: Keys of a schema whose values aren't schemas by themselves.
OWN_KEYS = ("properties", "items", "required", "type", "additionalProperties")


def closed(node: Any) -> Any:
    """A schema with all its objects closed and all their properties required, however deep they lie; references aren't followed."""
    if isinstance(node, list):
        return [closed(x) for x in node]
    if not isinstance(node, dict):
        return node
    kind = node.get("type")
    inside = {"properties": kind == "object", "items": kind == "array"}
    out = {k: v if k in OWN_KEYS else closed(v) for k, v in node.items()}
    for key, here in inside.items():
        if here and isinstance(node.get(key), dict):
            out[key] = {n: closed(v) for n, v in node[key].items()} if key == "properties" else closed(node[key])
    if kind == "object":
        out.setdefault("additionalProperties", False)
        if isinstance(node.get("properties"), dict):
            out["required"] = list(node["properties"])
    return out


def strict_schema(schema: Column) -> Column:
    """JSON schemas as text, made strict by `closed`; null where the text is no JSON or nested beyond what can be read. Keys keep their order."""

    @F.pandas_udf("string")
    def strict(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(closed(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return strict(schema)


#: What a column's type asks of a value, as a JSON schema.
TYPES = {
    "PHONE": r'{"type":"string","pattern":"^\\(?\\d{2}\\)?\\s*\\d{4,5}-?\\d{4}$"}',
    "EMAIL": '{"type":"string","format":"email"}',
    "DATE": r'{"type":"string","pattern":"^\\d{2}/\\d{2}/\\d{4}$"}',
    "NAME": '{"type":"string","minLength":1}',
    "SECTOR": '{"type":"string","minLength":1}',
    "ROLE": '{"type":"string","minLength":1}',
    "VERSION": r'{"type":"string","pattern":"^\\d+\\.\\d+(?:\\.\\d+)?$"}',
    "NUMBER": '{"type":"integer","minimum":0}',
    "FREE": '{"type":"string"}',
}


def table_schema(columns: DataFrame) -> DataFrame:
    """columns: schema, ord, name, type, required. schema, json: an object with the list of records, each a closed object of the columns in order. Unknown types ask for text."""
    quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    one = F.concat(quote(F.col("name")), F.lit(":"), F.coalesce(F.try_element_at(kinds, F.upper("type")), F.lit('{"type":"string"}')))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("ord", c.alias("p"))))), lambda x: x["p"]), ",")
    by = columns.groupBy("schema").agg(listed(one).alias("_p"), listed(F.when(F.col("required"), quote(F.col("name")))).alias("_r"))
    text = F.concat(F.lit('{"type":"object","additionalProperties":false,"properties":{"records":{"type":"array","items":{"type":"object","additionalProperties":false,"properties":{'), "_p", F.lit('},"required":['), "_r",
                    F.lit(']}}},"required":["records"]}'))
    return by.select("schema", text.alias("json"))


PLAN = "header_substitutions map<string,variant>, section_content map<string,variant>, table_data array<variant>, paragraph_rewrites array<variant>, cell_fills array<variant>"
_ITEM = "kind string, seq int, key string, value string, table_no int, row int, col int, rec map<string,string>, reason string"


def _found(answers: DataFrame) -> DataFrame:
    """All items of the answers' plans, with the reason why one is dropped."""
    p = answers.select("doc_id", F.try_parse_json("response").alias("_v"), F.from_json("response", PLAN).alias("_p"))
    clean = lambda c: F.regexp_replace(c, CONTROL, "")
    text = lambda v, path: F.try_variant_get(v, path, "string")
    kind = lambda v: F.schema_of_variant(v)
    is_object = lambda v: kind(v).startswith("OBJECT")
    whole = {"kind": "string", "seq": "int", "key": "string", "value": "string", "table_no": "int", "row": "int", "col": "int", "rec": "map<string,string>", "reason": "string"}

    def items(df: DataFrame, name: str, reason: Column, **given) -> DataFrame:
        return df.select("doc_id", *[(F.lit(name) if c == "kind" else reason if c == "reason" else given.get(c, F.lit(None))).cast(t).alias(c) for c, t in whole.items()])

    value, seq = F.col("v"), F.col("seq")
    out = items(p.where(F.col("_v").isNull() | ~is_object(F.col("_v"))), "plan", F.lit("no object"))
    for name, field in (("header", "header_substitutions"), ("section", "section_content")):
        rows = p.select("doc_id", F.posexplode(f"_p.{field}").alias("seq", "k", "v"))
        bad = F.when(value.isNull() | (kind(value) != "STRING"), "value is no text")
        out = out.unionByName(items(rows, name, bad, seq=seq, key=clean(F.col("k")), value=clean(text(value, "$"))))
    each = lambda field: p.select("doc_id", F.posexplode(f"_p.{field}").alias("seq", "v"))
    no_object = F.when(value.isNull() | ~is_object(value), "no object")
    number = lambda path: F.try_variant_get(value, path, "int")
    string = lambda path: kind(F.try_variant_get(value, path, "variant")) == "STRING"
    tables = each("table_data").withColumn("_t", number("$.template_table_index")).withColumn("_rows", F.try_variant_get(value, "$.rows", "array<variant>"))
    bad = no_object.when(F.col("_t").isNull(), "bad address")
    out = out.unionByName(items(tables.where(bad.isNotNull()), "record", bad))
    rows = tables.where(bad.isNull()).select("doc_id", "seq", "_t", F.posexplode("_rows").alias("_n", "v"))
    rec = F.try_variant_get(value, "$", "map<string,string>")
    out = out.unionByName(items(rows, "record", F.when(value.isNull() | ~is_object(value), "row is no object"), seq=seq * 10000 + F.col("_n"), table_no=F.col("_t"), rec=rec))
    bad = no_object.when(~F.coalesce(string("$.match_text") & string("$.replacement_text"), F.lit(False)), "value is no text").when(F.trim(text(value, "$.match_text")) == "", "nothing to match")
    out = out.unionByName(items(each("paragraph_rewrites"), "rewrite", bad, seq=seq, key=text(value, "$.match_text"), value=text(value, "$.replacement_text")))
    at = {"table_no": number("$.table_index"), "row": number("$.row"), "col": number("$.col")}
    bad = no_object.when(at["table_no"].isNull() | at["row"].isNull() | at["col"].isNull(), "bad address")
    return out.unionByName(items(each("cell_fills"), "cell", bad, seq=seq, value=clean(F.coalesce(text(value, "$.new_text"), F.lit(""))), **at))


def parse_plans(answers: DataFrame) -> DataFrame:
    """answers: doc_id, response (JSON). doc_id, kind, seq, key, value, table_no, row, col, rec: the well-formed items of each plan, as plan_edits takes them.

    Texts lose control characters; numbers of addresses may come as text. Missing lists are empty, and malformed items are left out (see dropped_items)."""
    return _found(answers).where("reason IS NULL").drop("reason")


def dropped_items(answers: DataFrame) -> DataFrame:
    """doc_id, kind, reason, n: how many items of each plan are malformed, and in what way; a response that is no object counts as one of kind plan."""
    return _found(answers).where("reason IS NOT NULL").groupBy("doc_id", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))
