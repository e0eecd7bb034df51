"""Scalar functions P1-P16: projections and casts, all built-in expressions."""

from __future__ import annotations

import string
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_thousands(col: Column | str) -> Column:
    """``'1,234'`` -> 1234; unparsable text -> NULL instead of an abort."""
    return F.regexp_replace(_c(col), ",", "").try_cast("bigint")


def default_zero(col: Column | str) -> Column:
    """Missing key -> 0."""
    return F.coalesce(_c(col), F.lit(0))


def error_count(errors_json: Column | str) -> Column:
    """Number of scanner errors in the raw JSON text of the errors array."""
    return F.coalesce(F.json_array_length(_c(errors_json)), F.lit(0))


def error_text(errors_json: Column | str) -> Column:
    """The errors as JSON text; the text ``'null'`` (not SQL NULL) when
    there are none, as the loader stores them."""
    return F.when(error_count(errors_json) == 0, F.lit("null")).otherwise(_c(errors_json))


def strip_plugins_dir(path: Column | str) -> Column:
    """Remove every ``plugins/`` substring."""
    return F.replace(_c(path), F.lit("plugins/"), F.lit(""))


# Fixed value: the local site the dynamic runner calls.
SITE = "http://localhost:8080"


def url_faithful(url: Column | str) -> Column:
    """P5 faithful: Python ``str.strip(chars)`` - trims any of the characters
    of ``http://localhost:8080`` from both ends (eats ``/slots`` down to ``/``)."""
    return F.btrim(_c(url), F.lit(SITE))


def url_fixed(url: Column | str) -> Column:
    """P5 fixed: remove the site prefix only."""
    return F.regexp_replace(_c(url), "^" + SITE.replace(".", "\\."), "")


def rule_sink(rule_id: Column | str) -> Column:
    """sink = part before ``_`` when the id has exactly one ``_``."""
    parts = F.split(_c(rule_id), "_")
    return F.when(F.size(parts) == 2, F.element_at(parts, 1))


def hook_to_route_closure(hook: Column | str) -> tuple[Column, Column]:
    """P8, closure branch: strip quotes, drop every ``wp_ajax_``; a leading
    ``nopriv_`` marks an unprivileged route and every ``nopriv_`` is dropped."""
    h = F.btrim(_c(hook), F.lit("'\""))
    a = F.replace(h, F.lit("wp_ajax_"), F.lit(""))
    nopriv = a.startswith("nopriv_")
    action = F.when(nopriv, F.replace(a, F.lit("nopriv_"), F.lit(""))).otherwise(a)
    return action, ~nopriv


def hook_to_route_callback(hook: Column | str) -> tuple[Column, Column]:
    """P8, callback branch: strip ``'`` ``"`` ``.``; drop only the first
    (leading) ``wp_ajax_nopriv_`` or ``wp_ajax_``.  Other hooks give NULLs
    (the reference would reuse the previous row's values - a bug)."""
    h = F.btrim(_c(hook), F.lit("'\"."))
    is_np = h.startswith("wp_ajax_nopriv_")
    is_p = h.startswith("wp_ajax_")
    action = (F.when(is_np, F.regexp_replace(h, "^wp_ajax_nopriv_", ""))
              .when(is_p, F.regexp_replace(h, "^wp_ajax_", "")))
    priv = F.when(is_np, F.lit(False)).when(is_p, F.lit(True))
    return action, priv


def other_calls(called: Column | str, ok: Column | str) -> Column:
    """Generated column ``other = called - ok``."""
    return _c(called) - _c(ok)


def command_or_url(interface: Column | str, url: Column | str) -> tuple[Column, Column]:
    """P10: for WP-CLI rows the ``url`` field holds the command."""
    cli = _c(interface) == "WP_CLI"
    return F.when(cli, _c(url)), F.when(~cli, url_faithful(url))


def http_outcome(status: Column | str) -> Column:
    """200 ok, >=500 server error, anything else other; NULL stays NULL."""
    s = _c(status)
    return (F.when(s == 200, F.lit("ok"))
            .when(s >= 500, F.lit("server_error"))
            .when(s.isNotNull(), F.lit("other")))


# ---------------------------------------------------------------------------
# Fixed values for P12/P13: sample argument values per declared type/format,
# as the runner picks them, rendered as Python renders them into a URL.
# ---------------------------------------------------------------------------
PRINTABLE = string.printable
MAXSIZE = sys.maxsize
FORMAT_SAMPLES = {
    "uri": "http://example.com",
    "email": "test@test.com",
    "ip": "127.0.0.1",
    "uuid": "123e4567-e89b-12d3-a456-426614174000",
    "hex-color": "#ffffff",
}
VALID_BY_TYPE = {
    "null": str(None),
    "boolean": str(True),
    "integer": str(MAXSIZE),
    "number": str(1.23456789),
    "array": str([PRINTABLE, 123, True, None]),
    "object": str({PRINTABLE: PRINTABLE}),
}
INVALID_MAXSIZE_TYPES = ["string", "null", "boolean"]


def valid_sample(arg_type: Column | str, fmt: Column | str, now_iso: str) -> Column:
    """Text of a valid value for a declared type (+ string format).

    ``now_iso`` stands for the runner's clock and is passed in, so one run
    gives one deterministic answer.
    """
    t, f = _c(arg_type), _c(fmt)
    fmt_val = F.lit("test")
    for k, v in FORMAT_SAMPLES.items():
        fmt_val = F.when(f == k, F.lit(v)).otherwise(fmt_val)
    fmt_val = F.when(f == "date-time", F.lit(now_iso)).otherwise(fmt_val)
    out = F.when(t == "string", F.when(f.isNotNull(), fmt_val).otherwise(F.lit(PRINTABLE)))
    for k, v in VALID_BY_TYPE.items():
        out = out.when(t == k, F.lit(v))
    return out.otherwise(F.lit(PRINTABLE))


def invalid_sample(arg_type: Column | str) -> Column:
    """Text of a value of the wrong type."""
    t = _c(arg_type)
    return F.when(t.isin(*INVALID_MAXSIZE_TYPES), F.lit(str(MAXSIZE))).otherwise(F.lit(PRINTABLE))


# Fixed value: request-argument access in PHP source, quotes must match.
REQUEST_ARG_RE = r"""\$_(REQUEST|POST|FILES|GET)\s*\[\s*(['"])([^'"]+)\2\s*\]"""


def request_args(text: Column | str) -> Column:
    """array<struct<method, arg>> of every ``$_POST['x']``-style access,
    in text order (two extractions zipped; Java regex has the back-reference)."""
    c = _c(text)
    methods = F.regexp_extract_all(c, F.lit(REQUEST_ARG_RE), 1).alias("method")
    args = F.regexp_extract_all(c, F.lit(REQUEST_ARG_RE), 3).alias("arg")
    return F.arrays_zip(methods, args)


def params_text(params: Column | str) -> Column:
    """Canonical text of a params array: ``[a, b]``."""
    return F.concat(F.lit("["), F.array_join(_c(params), ", "), F.lit("]"))
