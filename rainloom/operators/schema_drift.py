"""Files whose columns drift: one consistent table, and a report of every change.

A file's header is split into columns and each canonical field gets an explicit migration step: where its
column stands, under which name (rename) and of which kind (cast), or that it has none (default). The chain
of a file's steps is its fingerprint; files of one logger in time order form versions of its schema. Both
results are read off that chain: the report compares the steps of neighbouring files, the consistent table
executes the steps of each line's file. A name that no rule knows is learnt as a rename where it is the one
new column of the kind that a watched field had in the logger's preceding file.

Everything is a DataFrame plan. Per-file work touches only the small file table; the lines are read
once to find undeclared types (only for files that declare none) and once to be parsed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.session import staged

# Names under which the files hold the two watched fields (lower case, trimmed).
ALIASES = {
    "raw_drop_concentration": (
        "raw_drop_concentration",
        "raw_concentration",
        "drop_number_density",
        "drop_conc_spectrum",
        "logn_bins",
        "n_d",
        "fieldn",
        "field_90",
    ),
    "weather_code_synop_4677": (
        "weather_code_synop_4677",
        "weather_code_4677",
        "present_weather_ww",
        "synop4677",
        "synop_ww",
        "ww_4677",
        "ww_code",
        "field_04",
    ),
}

# Spellings of declared types (lower case, without blanks) and the kind each one means.
TYPE_KINDS = {
    "integer": ("int", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "integer", "long", "bigint", "smallint"),
    "decimal": ("float", "float32", "float64", "double", "decimal", "real", "number", "numeric"),
    "text": ("str", "string", "text", "varchar", "char", "object"),
    "list of decimals": ("list<float>", "list<double>", "float[]", "double[]", "array(float)", "array(double)", "array<float>", "array<double>", "list<float32>", "list<float64>"),
    "list of integers": ("list<int>", "list<integer>", "int[]", "integer[]", "array(int)", "array(integer)", "array<int>", "list<int32>", "list<int64>"),
}

SEPARATORS = (";", "|", "\t", ",")
MISSING_CELLS = ("", "nan", "null", "none", "na", "n/a", "--")


@dataclass(frozen=True)
class FieldRules:
    """The chain of rules one canonical field goes through."""

    name: str
    aliases: tuple[str, ...] = ()
    kind: str = "text"


@dataclass(frozen=True)
class SchemaRegistry:
    """The canonical table: its fields in order, each with the names it may have had and its kind."""

    fields: tuple[FieldRules, ...] = field(
        default_factory=lambda: (
            FieldRules("time", ("time", "datetime", "timestamp"), "timestamp"),
            FieldRules("rainfall_rate_32bit", kind="decimal"),
            FieldRules("weather_code_synop_4680", kind="integer"),
            FieldRules("weather_code_synop_4677", ALIASES["weather_code_synop_4677"], "integer"),
            FieldRules("weather_code_nws", kind="text"),
            FieldRules("mor_visibility", kind="decimal"),
            FieldRules("sensor_temperature", kind="decimal"),
            FieldRules("sensor_battery_voltage", kind="decimal"),
            FieldRules("sensor_status", kind="integer"),
            FieldRules("raw_drop_concentration", ALIASES["raw_drop_concentration"], "list of decimals"),
            FieldRules("raw_drop_average_velocity", kind="list of decimals"),
        )
    )
    watched: tuple[str, ...] = ("raw_drop_concentration", "weather_code_synop_4677")

    def aliases(self, name: str) -> tuple[str, ...]:
        rules = next(f for f in self.fields if f.name == name)
        return rules.aliases or (name,)


def _separator(header: Column) -> Column:
    return F.coalesce(*[F.when(F.instr(header, s) > 0, F.lit(s)) for s in SEPARATORS], F.lit(";"))


def _cells(payload: Column, separator: Column) -> Column:
    """The cells of a line; a quoted cell keeps its separators and loses its quotes."""
    out = None
    for s in SEPARATORS:
        escaped = {"|": r"\|", "\t": r"\t"}.get(s, s)
        found = F.regexp_extract_all(F.concat(payload, F.lit(s)), F.lit(rf'("[^"]*"|[^{escaped}]*){escaped}'), F.lit(1))
        out = F.when(separator == s, found) if out is None else out.when(separator == s, found)
    return F.transform(out, lambda c: F.trim(F.regexp_replace(c, '"', "")))


def _whole(cells: Column, n_columns: Column) -> Column:
    """The cells without the empty one that a separator at the line's end leaves."""
    closed = (F.size(cells) == n_columns + 1) & (F.try_element_at(cells, F.lit(-1)) == "")
    return F.when(closed, F.slice(cells, 1, n_columns)).otherwise(cells)


def _kind(declared: Column) -> Column:
    clean = F.lower(F.regexp_replace(declared, r"\s", ""))
    out = F.lit(None).cast("string")
    for kind, spellings in TYPE_KINDS.items():
        out = F.when(clean.isin(*spellings), F.lit(kind)).otherwise(out)
    return out


def _cell_kind(cell: Column) -> Column:
    """The kind a single cell speaks for; null where it says nothing."""
    number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return (
        F.when(cell.isNull() | F.lower(F.trim(cell)).isin(*MISSING_CELLS), F.lit(None))
        .when(cell.rlike(r"^\s*[+-]?\d+\s*$"), F.lit("integer"))
        .when(cell.rlike(rf"^\s*{number}\s*$"), F.lit("decimal"))
        .when(cell.rlike(r"^\s*[+-]?\d+(\s*,\s*[+-]?\d+)+\s*,?\s*$"), F.lit("list of integers"))
        .when(cell.rlike(rf"^\s*{number}(\s*,\s*{number})+\s*,?\s*$"), F.lit("list of decimals"))
        .otherwise(F.lit("text"))
    )


def routed_files(files: DataFrame, registry: SchemaRegistry | None = None, learnt: DataFrame | None = None) -> DataFrame:
    """Each file with its separator, its columns and, per canonical field, position, name and declared kind.

    ``learnt`` has further names of fields by logger, see ``learnt_names``. Nulls: a file without header
    has no columns. Where two columns of a file are names of the same field the first one counts. Extra
    columns of ``files`` are dropped.
    """
    registry = registry or SchemaRegistry()
    separator = _separator(F.col("header"))
    names = F.transform(F.split(F.coalesce(F.col("header"), F.lit("")), r"[;|\t,]"), lambda c: F.lower(F.trim(c)))
    types = F.split(F.col("column_types"), r"[;|\t]")
    base = files.select("file_id", "logger_id", "station_id", "period_start", "received", separator.alias("separator"), names.alias("names"), types.alias("types"))
    known = F.create_map(*[F.lit(x) for f in registry.fields for name in registry.aliases(f.name) for x in (name, f.name)])
    field_of = lambda c: F.try_element_at(known, c)
    if learnt is not None:
        own = learnt.groupBy("logger_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "field_name"))).alias("own_names"))
        base = base.join(own, "logger_id", "left")
        field_of = lambda c: F.coalesce(F.try_element_at(known, c), F.try_element_at("own_names", c))
    # Steps of their own: the optimiser would else copy each into all that read it.
    base = staged(base, {"fields": F.transform("names", field_of), "kinds": F.transform("types", _kind)})
    base = base.withColumns({f"pos_{f.name}": F.coalesce(F.array_position("fields", F.lit(f.name)), F.lit(0)).cast("int") for f in registry.fields})
    at = lambda array, f: F.when(F.col(f"pos_{f}") > 0, F.try_element_at(array, F.col(f"pos_{f}")))
    named = {f"name_{f.name}": at(F.col("names"), f.name) for f in registry.fields} | {f"kind_{f.name}": at(F.col("kinds"), f.name) for f in registry.fields}
    return staged(base, named).drop("fields", "own_names")


def _in_order() -> Window:
    return Window.partitionBy("logger_id").orderBy("period_start", "received", "file_id")


def learnt_names(files: DataFrame, registry: SchemaRegistry | None = None) -> DataFrame:
    """logger_id, name, field_name: names no rule knows under which a watched field of a logger goes on.

    A field goes on if the preceding file held it, this one does not, and this one has just one new column
    of an unknown name that declares the kind the field last declared. A name counts for all files of its
    logger. Only the file table is read.
    """
    registry = registry or SchemaRegistry()
    known = F.array(*[F.lit(a) for f in registry.fields for a in registry.aliases(f.name)])
    ordered = routed_files(files, registry).where("logger_id is not null and period_start is not null")
    before = {f"was_{c}": F.lag(c).over(_in_order()) for c in ("names", *[f"pos_{w}" for w in registry.watched])}
    earlier = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    before |= {f"was_kind_{w}": F.last(f"kind_{w}", ignorenulls=True).over(earlier) for w in registry.watched}
    ordered = ordered.withColumns(before).withColumn("fresh", F.array_except(F.array_except("names", F.coalesce("was_names", F.array().cast("array<string>"))), known))
    typed = F.zip_with("names", F.coalesce("kinds", F.array().cast("array<string>")), lambda n, k: F.struct(n.alias("name"), k.alias("kind")))
    found = []
    for w in registry.watched:
        fitting = F.filter(typed, lambda x: F.array_contains(F.col("fresh"), x["name"]) & (x["kind"] == F.col(f"was_kind_{w}")))
        gone = (F.col(f"pos_{w}") == 0) & (F.col(f"was_pos_{w}") > 0) & (F.size(fitting) == 1)
        found.append(F.when(gone, F.struct(F.try_element_at(fitting, F.lit(1))["name"].alias("name"), F.lit(w).alias("field_name"))))
    rows = ordered.where(F.size("fresh") > 0).select("logger_id", F.inline(F.array_compact(F.array(*found))))
    # A name that stands for two fields tells nothing.
    return rows.groupBy("logger_id", "name").agg(F.min("field_name").alias("field_name"), F.count_distinct("field_name").alias("n")).where("n = 1").drop("n")


def typed_files(files: DataFrame, lines: DataFrame, registry: SchemaRegistry | None = None, learnt: DataFrame | None = None) -> DataFrame:
    """Routed files whose undeclared kinds are read from their cells.

    Only lines of files that declare no kind for a watched field they hold are parsed. Each whole line
    (as many cells as the header) votes; cut and stray lines, repeated headers and missing cells do
    not. The most frequent kind wins, a tie goes to the wider kind (text, decimals, integers). Where no
    cell speaks the kind stays null.
    """
    registry = registry or SchemaRegistry()
    routed = routed_files(files, registry, learnt)
    unknown = F.lit(False)
    for w in registry.watched:
        unknown = unknown | ((F.col(f"pos_{w}") > 0) & F.col(f"kind_{w}").isNull())
    silent = routed.where(unknown).select("file_id", "separator", F.size("names").alias("n_columns"), *[f"{c}_{w}" for w in registry.watched for c in ("pos", "name")])
    cells = lines.select("file_id", "payload").where(F.col("payload").isNotNull()).join(silent, "file_id").withColumn("cells", _whole(_cells(F.col("payload"), F.col("separator")), F.col("n_columns")))
    whole = cells.where(F.size("cells") == F.col("n_columns"))

    def vote(w: str) -> Column:
        cell = F.try_element_at("cells", F.when(F.col(f"pos_{w}") > 0, F.col(f"pos_{w}")))
        return F.when(F.lower(F.trim(cell)) != F.col(f"name_{w}"), _cell_kind(cell))

    kinds = ("text", "list of decimals", "decimal", "list of integers", "integer")
    counted = whole.select("file_id", *[vote(w).alias(w) for w in registry.watched]).groupBy("file_id").agg(
        *[F.count_if(F.col(w) == k).alias(f"{w}|{k}") for w in registry.watched for k in kinds]
    )

    def winner(w: str) -> Column:
        most = F.greatest(*[F.col(f"`{w}|{k}`") for k in kinds])
        return F.when(most > 0, F.coalesce(*[F.when(F.col(f"`{w}|{k}`") == most, F.lit(k)) for k in kinds]))

    told = counted.select("file_id", *[winner(w).alias(f"told_{w}") for w in registry.watched])
    joined = routed.join(told, "file_id", "left")
    return joined.withColumns({f"kind_{w}": F.coalesce(f"kind_{w}", F.when(F.col(f"pos_{w}") > 0, F.col(f"told_{w}"))) for w in registry.watched}).drop(*[f"told_{w}" for w in registry.watched])


def _steps(registry: SchemaRegistry) -> Column:
    """The migration steps of a file to the canonical table, one per field in its order.

    action is ``keep``, ``rename`` or ``default``; a step whose kind differs from its target also casts.
    """

    def step(rule: FieldRules) -> Column:
        position, name = F.col(f"pos_{rule.name}"), F.col(f"name_{rule.name}")
        action = F.when(position == 0, "default").when(name == rule.name, "keep").otherwise("rename")
        return F.struct(F.lit(rule.name).alias("field"), action.alias("action"), name.alias("source"), position.alias("position"), F.when(position > 0, F.col(f"kind_{rule.name}")).alias("kind"), F.lit(rule.kind).alias("target"))

    return F.array(*[step(rule) for rule in registry.fields])


def _step(steps: str, registry: SchemaRegistry, name: str) -> Column:
    return F.try_element_at(F.col(steps), F.lit([f.name for f in registry.fields].index(name) + 1))


def schema_versions(files: DataFrame, lines: DataFrame, registry: SchemaRegistry | None = None) -> DataFrame:
    """Per file: its migration steps to the canonical table, their fingerprint, and the version of the logger's schema.

    Order within a logger is period_start, then received, then file_id. The version counts the changes
    of fingerprint so far, from 1. A kind that no cell tells keeps the last known kind of the logger.
    Files without logger_id or period_start have no predecessor and get version null. ``migration`` says
    the steps of the watched fields in words.
    """
    registry = registry or SchemaRegistry()
    order = _in_order()
    typed = typed_files(files, lines, registry, learnt_names(files, registry))
    placed = F.col("logger_id").isNotNull() & F.col("period_start").isNotNull()
    # The last kind that was known before the file: only for files whose cells say nothing.
    carried = {f"kind_{w}": F.when(F.col(f"pos_{w}") > 0, F.coalesce(f"kind_{w}", F.last(f"kind_{w}", ignorenulls=True).over(order))) for w in registry.watched}
    ordered = staged(typed.where(placed).withColumns(carried), {"steps": _steps(registry)})
    ordered = ordered.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.to_json("steps"), F.array_join(F.array_sort("names"), ",")), 256))
    ordered = ordered.withColumns({"prev_steps": F.lag("steps").over(order), "prev_fingerprint": F.lag("fingerprint").over(order), "is_first": F.row_number().over(order) == 1})
    changed = F.when(F.col("is_first") | (F.col("fingerprint") != F.col("prev_fingerprint")), 1).otherwise(0)
    ordered = ordered.withColumn("version", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    loose = typed.where(~placed).withColumn("steps", _steps(registry))
    told = []
    for w in registry.watched:
        s = _step("steps", registry, w)
        told += [
            F.when(s["action"] == "rename", F.concat(F.lit("rename "), s["source"], F.lit(f" -> {w}"))),
            F.when(s["kind"] != s["target"], F.concat(F.lit(f"cast {w} from "), s["kind"], F.lit(" to "), s["target"])),
            F.when(s["action"] == "default", F.lit(f"default {w} = null")),
        ]
    return ordered.unionByName(loose, allowMissingColumns=True).withColumn("migration", F.array_compact(F.array(*told)))


def schema_changes(files: DataFrame, lines: DataFrame, registry: SchemaRegistry | None = None) -> DataFrame:
    """One row per change of a watched field against the logger's preceding file: file_id, field_name, change.

    Read off the recorded steps: change is added, removed, renamed or retyped; one file may both rename
    and retype. The first file of a logger, and a file without logger or period, has none. Empty tables
    give no rows.
    """
    registry = registry or SchemaRegistry()
    versions = schema_versions(files, lines, registry).where("prev_steps is not null and fingerprint != prev_fingerprint")
    found = []
    for w in registry.watched:
        now, then = _step("steps", registry, w), _step("prev_steps", registry, w)
        here, there = now["action"] != "default", then["action"] != "default"
        for change, when in (
            ("added", here & ~there),
            ("removed", ~here & there),
            ("renamed", here & there & (now["source"] != then["source"])),
            ("retyped", here & there & (now["kind"] != then["kind"])),
        ):
            found.append(F.when(when, F.struct(F.lit(w).alias("field_name"), F.lit(change).alias("change"))))
    return versions.select("file_id", F.explode(F.array_compact(F.array(*found))).alias("c")).select("file_id", "c.field_name", "c.change")


def consistent_lines(files: DataFrame, lines: DataFrame, registry: SchemaRegistry | None = None) -> DataFrame:
    """All whole lines as one table of the registry's fields, each typed, with file_id, line_id, line_no.

    Each line goes through the migration steps of its file: the column at the step's position, whatever
    its name, cast from the step's kind to the field's, or the default. Integer lists of
    raw_drop_concentration hold the linear number density and become its decimal logarithm with -9.999
    for 0, as the decimal lists hold it. Text weather codes lose their letters. A cell that cannot be
    cast, and a missing cell, is null. Lines with another number of cells than the header, repeated
    headers and lines of unknown files are kept with ``line_status`` other than ``ok`` and null fields.
    """
    registry = registry or SchemaRegistry()
    plan = schema_versions(files, lines, registry).select("file_id", "separator", F.col("names").alias("_names"), "steps")
    joined = lines.select("line_id", "file_id", "line_no", "payload").join(plan, "file_id", "left")
    parsed = _cells(F.coalesce("payload", F.lit("")), F.coalesce("separator", F.lit(";")))
    joined = joined.withColumn("cells", _whole(parsed, F.coalesce(F.size("_names"), F.lit(0))))
    status = (
        F.when(F.col("_names").isNull(), "no file")
        .when(F.col("payload").isNull() | (F.trim("payload") == ""), "empty")
        .when(F.transform("cells", lambda c: F.lower(c)) == F.col("_names"), "header")
        .when(F.size("cells") < F.size("_names"), "cut")
        .when(F.size("cells") > F.size("_names"), "stray")
        .otherwise("ok")
    )
    joined = joined.withColumn("line_status", status)

    def value(rule: FieldRules) -> Column:
        step = _step("steps", registry, rule.name)
        cell = F.when((F.col("line_status") == "ok") & (step["position"] > 0), F.try_element_at("cells", F.when(step["position"] > 0, step["position"])))
        cell = F.when(~F.lower(cell).isin(*MISSING_CELLS), cell)
        if rule.kind == "timestamp":
            return F.try_to_timestamp(cell)
        if rule.kind == "integer":
            return F.when(step["kind"].isin("integer", "decimal"), cell.try_cast("double")).otherwise(F.regexp_replace(cell, r"^[A-Za-z_ ]+", "").try_cast("double")).cast("int")
        if rule.kind == "decimal":
            return cell.try_cast("double")
        if rule.kind == "list of decimals":
            parts = F.transform(F.split(cell, ","), lambda x: F.trim(x).try_cast("double"))
            logs = F.transform(parts, lambda x: F.when(x > 0, F.log10(x)).when(x.isNotNull(), F.lit(-9.999)))
            return F.when(step["kind"] == "list of integers", logs).otherwise(parts) if rule.name == "raw_drop_concentration" else parts
        return cell

    return joined.select("line_id", "file_id", "line_no", "line_status", *[value(rule).alias(rule.name) for rule in registry.fields])
