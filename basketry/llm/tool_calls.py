"""Tool calls of chats: link results by identifier, order calls by their references, validate arguments, serialise."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.storage import written

#: Groups of up to so many references are ordered in memory, each in one row.
SMALL_GROUP = 1_000
SALTS = 64
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def schema_errors(value, schema: Mapping, at: str = "$") -> list[str]:
    """What is wrong with a JSON value under the keywords type, enum, required, properties, additionalProperties (boolean), items, minimum, maximum and minLength."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if _is(value, "number"):
        found += [f"{at}: under minimum"] * ("minimum" in schema and value < schema["minimum"])
        found += [f"{at}: over maximum"] * ("maximum" in schema and value > schema["maximum"])
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            found += [f"{at}.{k}: unknown" for k in sorted(value) if k not in own]
        for k in sorted(own.keys() & value.keys()):
            found += schema_errors(value[k], own[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += schema_errors(x, schema["items"], f"{at}[{i}]")
    return found


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, text unescaped, whole floats as integers; NaN and infinities are refused."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _message(row: Mapping, schemas: Mapping[str, Mapping]) -> tuple[bool | None, str | None, str | None]:
    """Whether a call's arguments are valid, what is wrong with them, and the call with its result as canonical JSON."""
    if row["kind"] != "call":
        return None, None, None
    result = row["result"] if row["answered"] else None
    try:
        args = json.loads(row["arguments"]) if row["arguments"] is not None else None
        errors = schema_errors(args, schemas[row["name"]]) if row["name"] in schemas else ["$: no schema"]
        said = "; ".join(errors)
        text = canonical({"call": {"arguments": args, "id": row["call_id"], "name": row["name"]}, "result": result})
        said.encode(), text.encode()  # lone surrogates are no text
    except (ValueError, RecursionError):
        said, text = "$: not JSON", canonical({"call": {"arguments": row["arguments"], "id": row["call_id"], "name": row["name"]}, "result": result})
    return not said, said or None, text


def _messages(schemas: Mapping[str, Mapping]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_message(row, schemas) for row in batch.to_pylist()]
            keep = [n for n in batch.schema.names if n not in ("arguments", "result")]
            own = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            new = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*keep, "args_valid", "errors", "json"])

    return run


def _depths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the calls of small groups, one group a row."""
    for batch in batches:
        groups, calls, levels = [], [], []
        for group, edges in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            after: dict[str, list[str]] = {}
            open_: dict[str, int] = {}
            for e in edges:
                after.setdefault(e["ref"], []).append(e["call_id"])
                open_[e["call_id"]] = open_.get(e["call_id"], 0) + 1
            level = {ref: 0 for ref in after if ref not in open_}
            done = list(level)
            for ref in done:
                for call in after.get(ref, ()):
                    level[call] = max(level.get(call, 0), level[ref] + 1)
                    open_[call] -= 1
                    if not open_[call]:
                        done.append(call)
            for call in dict.fromkeys(e["call_id"] for e in edges):
                groups.append(group)
                calls.append(call)
                levels.append(None if open_[call] else level[call])
        yield pa.RecordBatch.from_arrays([pa.array(groups, batch.schema.types[0]), pa.array(calls, pa.string()), pa.array(levels, pa.int64())],
            names=["group_id", "call_id", "level"])


def _levels(edges: DataFrame) -> DataFrame:
    """``(group_id, call_id, level)`` of the calls that refer to others by ``edges (group_id, call_id, ref)``.

    A level is the length of the longest chain of references from a call, null on
    or behind a cycle. Groups of up to ``SMALL_GROUP`` references are ordered in one
    pass over groups. In larger ones the calls whose references are all done leave
    in rounds, one join each; the rounds are as many as the longest chain.
    """
    edges = written(edges, "references")
    sizes = edges.groupBy("group_id").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > SMALL_GROUP).select("group_id"), "large-groups")
    few = edges.join(large, "group_id", "left_anti").groupBy("group_id").agg(F.collect_list(F.struct("call_id", "ref")).alias("edges"))
    kind = dict(edges.dtypes)["group_id"]
    done = few.mapInArrow(_depths, f"group_id {kind}, call_id string, level long")
    if large.isEmpty():
        return done
    left = written(edges.join(large, "group_id", "left_semi"), "open")
    n, rounds = left.count(), []
    while n:
        rounds.append(left.select("group_id", "call_id").distinct().withColumn("level", F.lit(len(rounds) + 1).cast("long")))
        waiting = left.select("group_id", F.col("call_id").alias("ref")).distinct()
        left = written(left.join(waiting, ["group_id", "ref"], "left_semi"), "open")
        before, n = n, left.count()
        if n == before:  # only cycles and what is behind them
            break
    for part in rounds:
        done = done.unionByName(part)
    stuck = left.select("group_id", "call_id").distinct().withColumn("stuck", F.lit(True))
    done = done.groupBy("group_id", "call_id").agg(F.max("level").alias("level")).join(stuck, ["group_id", "call_id"], "left")
    return done.select("group_id", "call_id", F.when(F.col("stuck").isNull(), F.col("level")).alias("level"))


def _marked_first(rows: DataFrame, content: str) -> DataFrame:
    """``rows (group_id, call_id, pos, ...)`` with ``first``: is it the one that counts of its identifiers (least pos, then content)?

    Only rows that repeat an identifier are numbered, in ``SALTS`` parts first, so
    that one which many rows repeat is no single key.
    """
    ids = ["group_id", "call_id"]
    named = F.col("group_id").isNotNull() & F.col("call_id").isNotNull()
    repeated = written(rows.where(named).groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").select(*ids), "repeated-calls")
    if repeated.isEmpty():
        return rows.withColumn("first", named)
    order = ["pos", content, *(c for c in rows.columns if c not in (*ids, "pos", content))]
    again = rows.where(named).join(repeated, ids, "left_semi").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    again = again.withColumn("turn", F.row_number().over(Window.partitionBy(*ids, "salt").orderBy(*order)))
    again = again.withColumn("salt", F.when(F.col("turn") == 1, -1).otherwise(F.col("salt")))  # the first of each part meet
    again = again.withColumn("place", F.row_number().over(Window.partitionBy(*ids, "salt").orderBy(*order)))
    again = again.withColumn("first", (F.col("salt") == -1) & (F.col("place") == 1)).drop("salt", "turn", "place")
    alone = rows.where(named).join(repeated, ids, "left_anti").withColumn("first", F.lit(True))
    return written(again.unionByName(alone).unionByName(rows.where(~named).withColumn("first", F.lit(False))), "marked")


def _linked(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], ref_field: str, spare: bool) -> DataFrame:
    call_id = F.col("call_id").cast("string").alias("call_id")
    calls = _marked_first(calls.select("group_id", call_id, "pos", "name", "arguments"), "arguments")
    results = _marked_first(results.select("group_id", call_id, "pos", "result", "kind"), "result")
    own = calls.where("first").drop("first")
    answers = results.where("first").select("group_id", "call_id", "result", F.lit(True).alias("answered"))
    one = F.get_json_object("arguments", f"$.{ref_field}")
    refs = own.select("group_id", "call_id", F.explode(F.coalesce(F.from_json(one, "array<string>"),
        F.array(one))).alias("ref")).where("ref is not null").distinct()
    edges = refs.join(own.select("group_id", F.col("call_id").alias("ref")), ["group_id", "ref"], "left_semi")
    linked = own.join(answers.hint("shuffle_hash"), ["group_id", "call_id"],
        "left").join(_levels(edges.select("group_id", "call_id", "ref")).withColumn("refers", F.lit(True)), ["group_id", "call_id"], "left")
    level = F.when(F.col("refers").isNull(), F.lit(0).cast("long")).otherwise(F.col("level")).alias("level")
    no_text = F.lit(None).cast("string")
    linked = linked.select("group_id", "call_id", "pos", F.lit("call").alias("kind"), "name", F.coalesce("answered", F.lit(False)).alias("answered"),
        level, no_text.alias("text"), "arguments", "result")
    if spare:
        free = results.where("not first").unionByName(results.where("first").join(own.select("group_id", "call_id"), ["group_id", "call_id"], "left_anti"))
        rest = [(calls.where("not first"), F.lit("spare call"), F.col("name"), F.col("arguments")), (free, F.col("kind"), no_text, F.col("result"))]
        for rows, kind, name, text in rest:
            none = F.lit(None)
            linked = linked.union(rows.select("group_id", "call_id", "pos", kind.alias("kind"), name.alias("name"), none.cast("boolean"),
                none.cast("long"), text.alias("text"), no_text, no_text))
    kinds = ", ".join(f"{n} {t}" for n, t in linked.dtypes if n not in ("arguments", "result")) + ", args_valid boolean, errors string, json string"
    return linked.mapInArrow(_messages(schemas), kinds)


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], ref_field: str = "after") -> DataFrame:
    """One row per call: ``group_id, call_id, pos, name, answered, level, args_valid, errors, json``.

    ``calls (group_id, call_id, pos, name, arguments)`` and ``results (group_id,
    call_id, pos, result)`` meet on both identifiers. Of calls, or results, that
    repeat an identifier in a group the first counts (least pos, then content);
    calls without an identifier or group are dropped, results without a call too.
    The argument ``ref_field``, a string or an array of them, names calls of the
    same group that must come before; names of no call are ignored. ``level`` is the
    length of the longest chain of such references, so sorting a group by ``level,
    pos`` puts every call after those it names; calls on or behind a cycle have no
    level. Arguments that have no schema or break it come as invalid with the
    reasons, as do those that are no JSON, are nested too deeply to read, or hold
    half a surrogate pair; these come as a plain string in ``json``. Null arguments
    are JSON null, a null result is an answer of null. Extra columns are not read.
    """
    kinded = results.select("group_id", "call_id", "pos", "result", F.lit(None).cast("string").alias("kind"))
    return _linked(calls, kinded, schemas, ref_field, spare=False).drop("kind", "text")


def link_chat(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], ref_field: str = "after") -> DataFrame:
    """``link_calls`` with nothing lost: its rows, of ``kind`` ``call``, and a row for each input row that is in none of them.

    ``results`` has one more column, ``kind``, say the role. Results without a call,
    and those that repeat an identifier, come with their own kind and their content
    in ``text``; calls without an identifier, and repeated ones, as kind ``spare call``
    with their arguments in ``text``. So calls and results together are as many as
    the rows, each answered call counting twice.
    """
    return _linked(calls, results, schemas, ref_field, spare=True)
