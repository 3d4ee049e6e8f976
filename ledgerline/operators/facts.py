"""Facts of agenda items: schema, validation, explosion to rows, verification against documents, confidence routing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ledgerline.functions import constants as C
from ledgerline.functions import text as T


def _struct(**fields: S.DataType) -> S.StructType:
    return S.StructType([S.StructField(k, v, True) for k, v in fields.items()])


_STR, _DBL, _INT = S.StringType(), S.DoubleType(), S.IntegerType()
PROVENANCE = _struct(source_document=_STR, source_text=_STR, char_start=_INT, char_end=_INT)
PERSON = _struct(raw_name=_STR, canonical_name=_STR, role=_STR)
VOTE = _struct(person=PERSON, position=_STR)
VALUES = {
    "motions": _struct(text=_STR, moved_by=PERSON, seconded_by=PERSON, outcome=_STR, votes=S.ArrayType(VOTE), tally=_STR),
    "people": PERSON,
    "locations": _struct(raw_text=_STR, normalized_address=_STR, parcel_id=_STR, lat=_DBL, lon=_DBL),
    "amounts": _struct(raw_text=_STR, amount_usd=_STR, kind=_STR),
}
ITEM = _struct(item_number=_STR, title=_STR, item_type=_STR, **{f: S.ArrayType(_struct(value=v, confidence=_DBL, provenance=PROVENANCE)) for f, v in VALUES.items()})
#: Required members and closed sets of each value.
REQUIRED = {"motions": ["text", "outcome"], "people": ["raw_name", "role"], "locations": ["raw_text"], "amounts": ["raw_text", "kind"]}
CLOSED = {"motions": {"outcome": C.OUTCOMES}, "people": {"role": C.PERSON_ROLES}, "locations": {}, "amounts": {"kind": C.AMOUNT_KINDS}}


def _valid(field: str) -> Callable[[Column], Column]:
    """Whether one fact of the field has its required members and keeps to the closed sets."""

    def good(x: Column) -> Column:
        v = x["value"]
        checks = [x["confidence"].isNotNull(), x["provenance"]["source_document"].isNotNull(), x["provenance"]["source_text"].isNotNull(), *(v[m].isNotNull() for m in REQUIRED[field])]
        checks += [F.coalesce(v[m].isin(s), F.lit(False)) for m, s in CLOSED[field].items()]
        if field == "amounts":
            checks.append(v["amount_usd"].isNull() | v["amount_usd"].try_cast("decimal(18,2)").isNotNull())
        if field == "motions":
            checks.append(F.coalesce(F.forall(v["votes"], lambda w: F.coalesce(w["position"].isin(C.VOTE_POSITIONS), F.lit(False))), F.lit(True)))
        return reduce(lambda a, b: a & b, checks)

    return good


def parsed(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """The payload as `item`, and whether it is valid (`schema_valid`): it parses, required members are there, closed sets hold."""
    with_bad = S.StructType([*ITEM.fields, S.StructField("_corrupt_record", _STR)])
    item = F.from_json(json_col, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # exploded from an array of one, so that the payload is parsed once: filters would take a plain column's expression along, once for each member
    df = raw.select(*[c for c in raw.columns if c != "item"], F.explode(F.array(item)).alias("item"))
    ok: Column = F.col("item").isNotNull() & F.col("item._corrupt_record").isNull() & F.col("item.title").isNotNull() & F.coalesce(F.col("item.item_type").isin(C.ITEM_TYPES), F.lit(False))
    for field in C.FIELD_TYPES:
        ok = ok & F.coalesce(F.forall(F.col(f"item.{field}"), _valid(field)), F.lit(True))
    return df.withColumn("schema_valid", F.coalesce(ok, F.lit(False)))


def exploded(items: DataFrame, *keep: str) -> DataFrame:
    """One row per fact: case_id, field_type, idx (place in its list), value (JSON), confidence, source_text, source_document.

    keep: further columns of the item that its facts carry along.
    """

    def of(field: str) -> Column:
        fact = lambda x, i: F.struct(F.lit(field).alias("field_type"), i.alias("idx"), F.to_json(x["value"]).alias("value"), x["confidence"].alias("confidence"), x["provenance"]["source_text"].alias("source_text"), x["provenance"]["source_document"].alias("source_document"))
        return F.coalesce(F.transform(f"item.{field}", fact), F.array())

    return items.select("case_id", *keep, F.inline(F.concat(*map(of, C.FIELD_TYPES))))


def with_verification(facts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """facts with `verified`: their span stands verbatim in their case's document. documents: case_id, document_text; none where facts carry document_text."""
    joined = facts if documents is None else facts.join(documents.select("case_id", "document_text"), "case_id", "left")
    return joined.withColumn("verified", T.verified(F.col("source_text"), F.col("document_text"))).drop("document_text")


def drop_unverified(items: DataFrame) -> DataFrame:
    """Nested form: facts whose span is not in `document_text` leave their lists; source_document is overwritten."""
    for field in C.FIELD_TYPES:
        keep = F.filter(F.coalesce(F.col(f"item.{field}"), F.array().cast(ITEM[field].dataType)), lambda x: T.verified(x["provenance"]["source_text"], F.col("document_text")))
        stamped = F.transform(keep, lambda x: x.withField("provenance.source_document", F.col("source_document")))
        items = items.withColumn("item", F.col("item").withField(field, stamped))
    return items


def threshold(field: Column, thresholds: dict[str, float] | None = None) -> Column:
    thresholds = {**C.PUBLISH_THRESHOLDS, **(thresholds or {})}
    out = F.lit(None).cast("double")
    for name, value in thresholds.items():
        out = F.when(field == name, F.lit(value)).otherwise(out)
    return out


def routed(facts: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """facts with `route` (published from the threshold on, else queued) and `queue_id`."""
    route = F.when(F.col("confidence") >= threshold(F.col("field_type"), thresholds), "published").otherwise("queued")
    return facts.withColumns({"route": route, "queue_id": F.concat_ws("-", "case_id", "field_type", F.col("idx").cast("string"))})


def titled_entries(entries: DataFrame) -> DataFrame:
    """Entries with a title; `index` still counts those without. entries: meeting_id, entries array."""
    return entries.select("meeting_id", F.posexplode("entries").alias("index", "entry")).where(T.not_empty(F.col("entry.title")).isNotNull())


def is_consent(kind: Column) -> Column:
    return F.coalesce(F.contains(F.lower(kind), F.lit("consent")), F.lit(False))


def schema_document(schema: S.StructType = ITEM, depth: int = 0) -> list[str]:
    """Markdown lines that document a schema; comparing them with a stored copy shows drift."""
    lines = []
    for f in schema.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, S.ArrayType) else f.dataType
        lines.append(f"{'  ' * depth}- `{f.name}`: {'list of ' if inner is not f.dataType else ''}{inner.typeName()}{' (optional)' if f.nullable else ''}")
        if isinstance(inner, S.StructType):
            lines += schema_document(inner, depth + 1)
    return lines


def tool_definition(name: str, schema: S.StructType = ITEM) -> dict:
    """The schema as a forced-output tool of a model service."""

    def kind(t: S.DataType) -> dict:
        if isinstance(t, S.ArrayType):
            return {"type": "array", "items": kind(t.elementType)}
        if isinstance(t, S.StructType):
            return {"type": "object", "properties": {f.name: kind(f.dataType) for f in t.fields}}
        return {"type": {"string": "string", "double": "number", "integer": "integer", "boolean": "boolean"}.get(t.typeName(), "string")}

    return {"name": name, "input_schema": kind(schema)}
