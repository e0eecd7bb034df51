"""AJAX routes and their request arguments, found in plugin source.

* D11: ``add_action('wp_ajax_…', 'callback')`` -> (hook, callback); W4 keeps
  the last registration per (plugin, hook); P8 (callback branch) turns the
  hook into (action, priv).
* D12: ``add_action('wp_ajax_…', <second argument>)``; F11 keeps closures;
  P8 (closure branch); P14 reads ``$_POST['x']``-style arguments from the
  closure text.
* D13 + J9: functions of the plugin whose name matches the callback as a
  start-anchored regex (faithful: ``cb_1`` also hits ``cb_12``) or equals it
  (fixed); P14 on the function text.  The faithful match runs as an
  equi-join of name prefixes with the literal start of the callback; a
  function only emits the prefixes whose length some callback of its plugin
  has, so the join input stays near the number of functions.  Callbacks
  holding regex metacharacters are then matched on these candidates.
* J4: argument rows get the route id of their (plugin, action, priv); when
  a key has several routes the smallest id wins; unmatched rows are
  returned separately (quarantine) instead of reusing a previous id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.functions.predicates import is_closure
from leaklens.functions.scalar import (
    hook_to_route_callback,
    hook_to_route_closure,
    request_args,
)
from leaklens.operators.static_scan import IDENT, WS, slug_of

# Our textual contract for the route-finding rules (the reference uses an
# AST matcher); blanks are the explicit WS class shared with the oracle.
CALLBACK_RE = rf"""add_action{WS}*\({WS}*(['"]wp_ajax[^'"]*['"]){WS}*,{WS}*['"]([^'"]+)['"]{WS}*\)"""
REG_HEAD_RE = rf"""add_action{WS}*\({WS}*(['"]wp_ajax[^'"]*['"]){WS}*,{WS}*"""
# Source text as tokens that leave nothing out: strings, comments, brackets and
# commas each on their own, plain text in runs.  Possessive, so that Java does
# not recurse on long strings; the language is the same without.
TOKEN_RE = (r"""'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+'|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|//[^\n]*+|#[^\n]*+|/\*(?s:.*?)\*/"""
            r"""|[^'"#/(){}\[\],]++|(?s:.)""")
FUNC_HEAD_RE = rf"function{WS}+({IDENT}){WS}*\("
REGEX_META_RE = r"[\\.^$|?*+()\[\]{}]"


def callback_registrations(files: DataFrame) -> DataFrame:
    """(plugin, path, n, hook, callback) per named-callback registration
    (n = order inside the file)."""
    m = files.select(
        "path", slug_of("path").alias("plugin_slug"),
        F.arrays_zip(F.regexp_extract_all("content", F.lit(CALLBACK_RE), 1).alias("hook"),
                     F.regexp_extract_all("content", F.lit(CALLBACK_RE), 2).alias("callback")).alias("z"))
    return m.select("plugin_slug", "path", F.posexplode("z").alias("n", "r")).select(
        "plugin_slug", "path", "n", "r.hook", "r.callback")


def last_per_hook(regs: DataFrame, order: list[str], value_cols: list[str],
                  key: list[str] | None = None) -> DataFrame:
    """The last registration per (plugin, hook) wins.

    ``max_by`` over the ordering is an aggregate with map-side partial
    combine, so a plugin with very many registrations is not one task."""
    key = key or ["plugin_slug", "hook"]
    best = F.max_by(F.struct(*value_cols), F.struct(*order)).alias("v")
    return regs.groupBy(*key).agg(best).select(*key, "v.*")


def callback_routes(files: DataFrame) -> DataFrame:
    """D11 + W4 + P8: one route per (plugin, hook) with its callback."""
    last = last_per_hook(callback_registrations(files), ["path", "n"], ["callback"])
    action, priv = hook_to_route_callback("hook")
    return last.select("plugin_slug", "hook", "callback", action.alias("action"), priv.alias("priv"))


def _first_argument(text: Column) -> Column:
    """Fold over the tokens of a call argument that ``text`` starts with: its
    ``size`` in characters once ``done``, which is at the first comma or closing
    parenthesis outside all brackets, strings and comments.  ``torn``: before
    that stood a quote or slash alone, which a longer text may make part of a
    string or comment."""
    opened = lambda t: F.when(t.isin("(", "{", "["), 1).when(t.isin(")", "}", "]"), -1).otherwise(0)

    def step(s, t):
        ends = s["done"] | ((s["depth"] == 0) & t.isin(",", ")"))
        return F.struct(F.when(ends, s["depth"]).otherwise(s["depth"] + opened(t)).alias("depth"),
                        F.when(ends, s["size"]).otherwise(s["size"] + F.length(t)).alias("size"), ends.alias("done"),
                        (s["torn"] | (~ends & t.isin("'", '"', "/"))).alias("torn"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"), F.lit(False).alias("torn"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0)), start, step)


def second_arguments(files: DataFrame) -> DataFrame:
    """D12 + W4 + P8 (closure branch): the last registration per (plugin,
    hook) with its whole second argument, flagged by F11 (is it a closure?).

    Most arguments end before the next registration of the file, and are read
    from that stretch alone; only one that does not is read on, to the end of
    the file if need be.  A call that never closes is no registration."""
    head = rf"\A{REG_HEAD_RE}"
    parts = (files.filter(F.col("content").rlike(REG_HEAD_RE))
             .select("path", slug_of("path").alias("plugin_slug"), F.split("content", rf"(?={REG_HEAD_RE})").alias("parts")))

    def reach(part, i):
        own = _first_argument(F.regexp_replace(part, head, ""))
        onward = F.array_join(F.slice("parts", i + 1, F.size("parts") - i), "")
        return F.when(part.rlike(head), F.when(own["done"] & ~own["torn"], part).otherwise(onward))

    texts = parts.select("plugin_slug", "path", F.posexplode(F.transform("parts", reach)).alias("n", "text"))
    heads = (texts.filter("text is not null")
             .select("plugin_slug", "path", "n", F.regexp_extract("text", head, 1).alias("hook"),
                     F.regexp_replace("text", head, "").alias("rest"))
             .withColumn("first", _first_argument(F.col("rest"))).filter("first.done"))
    regs = heads.select("plugin_slug", "path", "n", "hook",
                        F.regexp_replace(F.expr("substring(rest, 1, first.size)"), rf"{WS}+\z", "").alias("closure"))
    last = last_per_hook(regs, ["path", "n"], ["closure"])
    action, priv = hook_to_route_closure("hook")
    return last.select("plugin_slug", "hook", "closure", action.alias("action"), priv.alias("priv"),
                       is_closure("closure").alias("is_closure"))


def closure_routes(files: DataFrame) -> DataFrame:
    """D12 + W4 + F11 + P8 + P14: closure routes with their arguments
    (array of (method, arg))."""
    return (second_arguments(files).filter("is_closure")
            .select("plugin_slug", "hook", "action", "priv", request_args("closure").alias("args")))


def functions_of(files: DataFrame) -> DataFrame:
    """One row per named function: text from its header to the next header
    (an approximation of the function body; the file is split with a
    zero-width look-ahead so no text is lost or invented)."""
    segs = files.select(slug_of("path").alias("plugin_slug"), "path",
                        F.explode(F.split("content", rf"(?={FUNC_HEAD_RE})")).alias("body"))
    return (segs.filter(F.col("body").rlike(rf"^{FUNC_HEAD_RE}"))
            .select("plugin_slug", "path", F.regexp_extract("body", rf"^{FUNC_HEAD_RE}", 1).alias("fname"),
                    "body"))


def literal_prefix(pattern: str) -> Column:
    """Characters that every match of a start-anchored pattern begins with:
    those before its first metacharacter, less the one that a following
    ``?``, ``*`` or ``{`` makes optional; none where there are alternatives."""
    plain = F.regexp_extract(pattern, r"\A([^\\.^$|?*+()\[\]{}]*)", 1)
    optional = F.regexp_like(pattern, F.lit(r"\A[^\\.^$|?*+()\[\]{}]+[?*{]"))
    return (F.when(F.contains(pattern, F.lit("|")), "")
            .when(optional, F.regexp_replace(plain, r"(?s).\z", "")).otherwise(plain))


def match_callbacks(routes: DataFrame, funcs: DataFrame, faithful: bool = True) -> DataFrame:
    """Routes x functions of the same plugin by callback name.

    faithful: function name starts with the callback (regex match anchored
    at the start); fixed: names are equal."""
    if not faithful:
        return routes.join(funcs.withColumnRenamed("fname", "callback"), ["plugin_slug", "callback"]) \
            .withColumn("fname", F.col("callback"))
    keyed = routes.withColumn("__lit", literal_prefix("callback"))
    # Only prefixes whose length some callback of the same plugin has can
    # match: per plugin, the set of lengths (bounded by identifier length).
    # The table is derived, so AQE sizes it at run time and broadcasts it when
    # small instead of a count forcing it twice.
    lengths = keyed.groupBy("plugin_slug").agg(F.collect_set(F.length("__lit")).alias("__lens"))
    prefixes = (funcs.join(lengths, "plugin_slug")
                .select("*", F.explode(F.filter("__lens", lambda n: n <= F.length("fname"))).alias("__n"))
                .withColumn("__lit", F.expr("substring(fname, 1, __n)"))
                .drop("__lens", "__n"))
    plain = ~F.col("callback").rlike(REGEX_META_RE)
    return (keyed.join(prefixes, ["plugin_slug", "__lit"]).drop("__lit")
            .filter(plain | F.expr("fname rlike concat('^', callback)")))


def callback_arguments(files: DataFrame, faithful: bool = True) -> DataFrame:
    """(plugin, action, priv, callback, function, method, arg) for every
    request argument read inside a function matched to a route callback.

    Arguments are read where the text is scanned; no function text is shuffled."""
    routes = callback_routes(files)
    funcs = (functions_of(files).select("plugin_slug", "fname", request_args("body").alias("args"))
             .filter(F.size("args") > 0))
    return (match_callbacks(routes, funcs, faithful)
            .select("plugin_slug", "action", "priv", "callback", "fname", F.explode("args").alias("a"))
            .select("plugin_slug", "action", "priv", "callback", "fname",
                    F.col("a.method").alias("method"), F.col("a.arg").alias("arg")))


def route_ids(routes: DataFrame) -> DataFrame:
    """Stable surrogate key per (plugin, action, priv) from a hash, so
    ids do not depend on listing order or on which executor ran a task."""
    return routes.select(
        F.xxhash64("plugin_slug", "action", "priv").alias("route_id"),
        "plugin_slug", "action", "priv").distinct()


def lookup_routes(args: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J4 + U6: (route_id, method, arg_name) rows, duplicates removed; and
    the argument rows whose route is unknown (quarantine)."""
    first = routes.groupBy("plugin_slug", "action", "priv").agg(F.min("route_id").alias("route_id"))
    keyed = args.join(first, ["plugin_slug", "action", "priv"], "left")
    ok = (keyed.filter(F.col("route_id").isNotNull())
          .select("route_id", "method", F.col("arg").alias("arg_name")).dropDuplicates())
    bad = keyed.filter(F.col("route_id").isNull()).drop("route_id")
    return ok, bad
