"""The typed warehouse (S9) with its constraints.

Eleven tables; each has typed columns, columns that may not be NULL, a key,
references to other tables and domains.  ``load`` checks and writes them in
the order of their references.  A table is checked and written in one pass:
rows that hold go to ``<root>/<table>/valid=true``, which is the table, all
others with the list of what they violate to ``valid=false``, the quarantine.
A row whose parent was quarantined is an orphan too.

Of several rows with one key the smallest one (by its columns in order) is
kept and the others are quarantined; keys are aggregated before the shuffle,
so a key with very many rows is no single task.

A large table is checked and written in parts, all rows of a key in one part;
the shuffle files of a part are gone before the next one, so they take no more
disk for more rows.  Shuffles carry a row's text (``raw``) only where it can't
be told from the typed columns.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leaklens.session import shuffles_dropped

PART_ROWS = 1 << 24     # about 2 GB of shuffle files for rows of 200 bytes


@dataclass(frozen=True)
class Table:
    """``columns``: name -> (type, may be NULL); ``references``: column ->
    (table, column); ``domains``: column -> its values."""

    columns: dict[str, tuple[str, bool]]
    key: tuple[str, ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _columns(required: str, optional: str = "") -> dict[str, tuple[str, bool]]:
    named = [(*c.split(), False) for c in required.split(",")] + [(*c.split(), True) for c in optional.split(",") if c]
    return {name: (kind, null) for name, kind, null in named}


_PLUGIN = {"plugin_slug": ("plugins", "slug")}
_TESTED = {"plugin_slug": ("dynamic_analysis", "plugin_slug")}
_CHANGE = "data string, name_of_changed_file string, type_of_operation string"

# Tables, columns, keys and references of the study's database,
# parents before their children.  Ids are 64-bit.
WAREHOUSE: dict[str, Table] = {
    "plugins": Table(_columns("name string, slug string, version string, download_link string, num_downloads int, active_installations int"),
                     ("slug",)),
    "dynamic_analysis": Table(_columns("plugin_slug string, num_unique_rest_endpoints int, num_rest_endpoints_called int, "
                                       "num_rest_endpoints_http_ok int, num_ajax_endpoints int, num_ajax_endpoints_called int, "
                                       "num_ajax_endpoints_http_ok int, time_spend double"), ("plugin_slug",), _PLUGIN),
    "ajax_routes": Table(_columns("route_id long, plugin_slug string, action string, priv boolean"), ("route_id",), _PLUGIN),
    "ajax_route_arguments": Table(_columns("route_id long, method string, arg_name string"), ("route_id", "method", "arg_name"),
                                  {"route_id": ("ajax_routes", "route_id")}),
    "semgrep_runs": Table(_columns("run_id long, plugin_slug string, error_count int", "errors string"), ("run_id",), _PLUGIN),
    "rules": Table(_columns("rule_id string, severity string", "sink string"), ("rule_id",),
                   domains={"severity": ("INFO", "ERROR", "WARNING")}),
    "findings_semgrep": Table(_columns("finding_id long, run_id long, rule_id string, file_path string, start_line int, end_line int",
                                       "message string, lines string"), ("finding_id",),
                              {"rule_id": ("rules", "rule_id"), "run_id": ("semgrep_runs", "run_id")}),
    "findings_rest": Table(_columns("finding_id long, plugin_slug string, url string, http_method string, zip_file_number long", _CHANGE),
                           ("finding_id",), _TESTED),
    "findings_ajax": Table(_columns("finding_id long, plugin_slug string, url string, http_method string, zip_file_number long", _CHANGE),
                           ("finding_id",), _TESTED),
    "findings_wp_cli": Table(_columns("finding_id long, plugin_slug string, command string, type_of_operation string, zip_file_number long",
                                      "name_of_changed_file string"), ("finding_id",), _TESTED),
    "findings_function_hooks": Table(_columns("finding_id long, plugin_slug string, function string, params string", "error string"),
                                     ("finding_id",), _TESTED),
}


def _listed(rules: list[tuple[Column, str]]) -> Column:
    """The names of the rules that are broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))


def typed(rows: DataFrame, table: Table) -> DataFrame:
    """``rows`` in the table's types, with ``raw`` (the row as it came) and
    ``violations`` of types, NULLs and domains."""
    missing = [c for c in table.columns if c not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in missing]).select(*table.columns)
    rules, cast = [], []
    for name, (kind, may_be_null) in table.columns.items():
        value = F.col(name).try_cast(kind)
        cast.append(value.alias(name))
        rules.append((F.col(name).isNotNull() & value.isNull(), f"type:{name}"))
        if not may_be_null:
            rules.append((F.col(name).isNull(), f"null:{name}"))
        if name in table.domains:
            rules.append((~F.col(name).isin(*table.domains[name]), f"domain:{name}"))
    return rows.select(*cast, F.to_json(F.struct(*rows.columns)).alias("raw"), _listed(rules).alias("violations"))


# Types that keep a value as it came, and its text; equal ones have one text
# (0.0 and -0.0, of a floating type, have two).
_EXACT = {"string": "string", "int": "int", "long": "bigint", "boolean": "boolean"}


def _retold(rows: DataFrame, table: Table) -> bool:
    """Whether ``raw`` can be made from the typed columns."""
    came = dict(rows.dtypes)
    return all(came[c] == _EXACT.get(kind) for c, (kind, _) in table.columns.items() if c in came)


def _unique(rows: DataFrame, table: Table) -> DataFrame:
    """``rows`` with the key violations added: one row per key keeps its place."""
    names = [c for c in rows.columns if c != "violations"]
    others = [c for c in names if c not in table.key]
    whole = F.struct(*others) if others else F.struct(F.lit(0).alias("__none"))
    faultless = F.size("violations") == 0
    good = rows.filter(faultless)
    for c in table.key:
        if not table.columns[c][1]:     # holds for all of them; said for the join's sake, which would ask it of one side
            good = good.filter(F.col(c).isNotNull())
    good = good.select(*names)
    # equal rows become one with their number; only rows of keys with several go on to a join
    # (every key has a number above 0: read by both uses, so that they share one shuffle)
    per = good.groupBy(*table.key).agg(F.min(whole).alias("__first"), F.count(F.lit(1)).alias("__n"))
    first = per.filter("__n > 0").select(*[F.col(c) if c in table.key else F.col(f"__first.{c}") for c in names])
    several = per.filter("__n > 1").select(*[F.col(c).alias(f"__{c}") for c in table.key], "__first")
    same_key = F.lit(True)
    for c in table.key:
        same_key = same_key & (F.col(c) == F.col(f"__{c}"))
    repeated = good.join(several, same_key).groupBy(*names, "__first").agg(F.count(F.lit(1)).alias("__n"))
    copies = F.col("__n") - F.when(whole == F.col("__first"), F.lit(1)).otherwise(F.lit(0))
    repeated = (repeated.withColumn("__n", copies).filter("__n > 0")
                .withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))))
    return (first.withColumn("violations", F.array().cast("array<string>"))
            .unionByName(repeated.select(*names, F.array(F.lit(f"key:{','.join(table.key)}")).alias("violations")))
            .unionByName(rows.filter(~faultless)))


def checked(rows: DataFrame, table: Table, parents: dict[str, DataFrame]) -> DataFrame:
    """``rows`` typed, with ``raw`` and all their ``violations``; ``parents``
    are the checked tables that ``table`` refers to."""
    retold = _retold(rows, table)
    rows = typed(rows, table)
    rows = _unique(rows.drop("raw") if retold else rows, table)
    for name, (parent, column) in table.references.items():
        known = parents[parent].select(F.col(column).alias("__parent"))
        rows = rows.join(known, rows[name] == known["__parent"], "left")
        orphan = F.col(name).isNotNull() & F.col("__parent").isNull()
        rows = rows.withColumn("violations", F.concat("violations", _listed([(orphan, f"orphan:{name}")]))).drop("__parent")
    raw = F.to_json(F.struct(*table.columns)) if retold else F.col("raw")
    return rows.select(*table.columns, raw.alias("raw"), "violations")


def _part(rows: DataFrame, table: Table, n: int, i: int) -> DataFrame:
    """Part ``i`` of ``n``; the rows of a key are in one part."""
    key = [(F.col(c) if c in rows.columns else F.lit(None).cast("string")).try_cast(table.columns[c][0]) for c in table.key]
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(n)) == i) if n > 1 else rows


def load(tables: dict[str, DataFrame], root: str, contract: dict[str, Table] = WAREHOUSE) -> dict[str, dict[str, int]]:
    """Check and write every table of ``contract``; returns the rows read, kept
    and quarantined of each, counted while they are written.

    Writes overwrite whole tables, so a repeated load leaves no duplicates."""
    counts, written = {}, {}
    for name, table in contract.items():
        spark, total = tables[name].sparkSession, Counter()
        with shuffles_dropped(spark):
            n = max(1, -(-tables[name].count() // PART_ROWS))
            for i in range(n):
                seen = Observation(f"load-{name}-{i}")
                rows = checked(_part(tables[name], table, n, i), table, written).withColumn("valid", F.size("violations") == 0)
                rows = rows.withColumn("raw", F.when(~F.col("valid"), F.col("raw"))).observe(
                    seen, F.count(F.lit(1)).alias("read"), F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("quarantined"))
                rows.write.mode("append" if i else "overwrite").partitionBy("valid").parquet(f"{root}/{name}")
                total.update(seen.get)
        counts[name] = dict(total)
        written[name] = read(spark, root, name, contract)
    return counts


def _schema(table: Table) -> str:
    return ", ".join(f"{c} {kind}" for c, (kind, _) in table.columns.items())


def read(spark: SparkSession, root: str, name: str, contract: dict[str, Table] = WAREHOUSE) -> DataFrame:
    """A table of the warehouse."""
    full = f"{_schema(contract[name])}, valid boolean"
    return spark.read.schema(full).parquet(f"{root}/{name}").filter("valid").drop("valid")


def quarantine(spark: SparkSession, root: str, name: str, contract: dict[str, Table] = WAREHOUSE) -> DataFrame:
    """The rows of a table that broke a rule: raw (JSON) and violations."""
    rows = spark.read.schema("raw string, violations array<string>, valid boolean").parquet(f"{root}/{name}")
    return rows.filter("not valid").drop("valid")
