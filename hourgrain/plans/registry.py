"""Named queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hourgrain.session import configure
from hourgrain.sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Common table expressions for the SQL side: name -> (needed names, body).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), """SELECT event_type AS site, ts, date_trunc('hour', ts) AS hour, event_id AS seq, value AS target,
        CASE WHEN user_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS ss,
        CASE user_id % 7 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS qc FROM events"""),
    "hourly": (("raw",), """SELECT site, hour AS timestamp, avg(target) AS target, bool_and(coalesce(qc, 0) = 0) AS instrument_ok,
        count(*) AS n FROM raw WHERE abs(ss - 0.4::DOUBLE) <= 0.000005::DOUBLE GROUP BY site, hour"""),
    "good": (("hourly",), "SELECT site, timestamp, target FROM hourly WHERE instrument_ok AND target >= 0"),
    "daily": ((), """SELECT o_orderpriority AS site, o_orderdate AS timestamp, avg(o_totalprice) AS value, count(*) AS n
        FROM orders GROUP BY o_orderpriority, o_orderdate"""),
    "spectra": ((), """SELECT vec_id, CAST(label AS VARCHAR) AS site, TIMESTAMP '2024-01-01 00:00:00' + to_hours(vec_id) AS timestamp,
        list_transform(embedding, lambda x: CASE WHEN x < -0.3 THEN NULL ELSE abs(CAST(x AS DOUBLE)) * 1000 END) AS density
        FROM embeddings"""),
    "pred": ((), """SELECT l_returnflag AS site, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS block_start,
        l_extendedprice / 1000 AS target, ln(1 + l_extendedprice / 1000) AS y, ln(1 + l_quantity * 1.5::DOUBLE) AS p0,
        ln(1 + l_quantity * 1.5::DOUBLE * (1 - l_discount)) AS p1, l_quantity / 50 AS prob0,
        (l_quantity / 50 + least(l_extendedprice / 100000, 1)) / 2 AS prob1,
        date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day FROM lineitem"""),
    "minutes": ((), "SELECT event_type AS var, ts, date_trunc('minute', ts) AS minute, value, user_id & 15 AS qc FROM events"),
    # channel axis with log10 cell edges, one row per channel
    "axis0": ((), "SELECT j, 10::DOUBLE * pow(50::DOUBLE, j::DOUBLE / 63) AS d FROM range(64) AS t(j)"),
    "axis": (("axis0",), """SELECT j, d, coalesce((c + p) / 2, c - (n - c) / 2) AS lo, coalesce((c + n) / 2, c + (c - p) / 2) AS hi
        FROM (SELECT j, d, log10(d) AS c, lag(log10(d)) OVER (ORDER BY j) AS p, lead(log10(d)) OVER (ORDER BY j) AS n FROM axis0)"""),
    "grid0": ((), "SELECT k, exp(ln(15::DOUBLE) + (ln(300::DOUBLE) - ln(15::DOUBLE)) / 24 * (k + 0.5::DOUBLE)) AS d FROM range(24) AS t(k)"),
    "grid": (("grid0",), """SELECT k, d, coalesce((c + p) / 2, c - (n - c) / 2) AS lo, coalesce((c + n) / 2, c + (c - p) / 2) AS hi
        FROM (SELECT k, d, log10(d) AS c, lag(log10(d)) OVER (ORDER BY k) AS p, lead(log10(d)) OVER (ORDER BY k) AS n FROM grid0)"""),
    # one row per spectrum and channel
    "cells": (("spectra", "axis"), """SELECT s.vec_id, s.site, s.timestamp, a.j, a.d, a.lo, a.hi, s.v FROM
        (SELECT vec_id, site, timestamp, unnest(range(64)) AS j, unnest(density) AS v FROM spectra) s JOIN axis a USING (j)"""),
    # mapped 24-bin spectra: linear in ln(d) between the usable neighbours, times the target width
    "mapped": (("cells", "grid"), """SELECT vec_id, site, timestamp, k, gd,
          CASE WHEN min(d_max) >= max(g_last) AND min(d_min) <= min(g_first) AND min(n_ok) >= 2 THEN
          (CASE WHEN arg_min(d, d) FILTER (WHERE d > gd) IS NULL THEN arg_max(v, d) FILTER (WHERE d <= gd) ELSE
          arg_max(v, d) FILTER (WHERE d <= gd) + (arg_min(v, d) FILTER (WHERE d > gd) - arg_max(v, d) FILTER (WHERE d <= gd))
          * (ln(gd) - ln(max(d) FILTER (WHERE d <= gd))) / (ln(min(d) FILTER (WHERE d > gd)) - ln(max(d) FILTER (WHERE d <= gd))) END) * any_value(w) END AS b
        FROM (SELECT c.vec_id, c.site, c.timestamp, c.d, c.v, g.k, g.d AS gd, g.hi - g.lo AS w,
                min(c.d) OVER (PARTITION BY vec_id) AS d_min, max(c.d) OVER (PARTITION BY vec_id) AS d_max,
                count(DISTINCT c.j) OVER (PARTITION BY vec_id) AS n_ok,
                (SELECT min(d) FROM grid) AS g_first, (SELECT max(d) FROM grid) AS g_last
              FROM cells c, grid g WHERE c.v >= 0) GROUP BY vec_id, site, timestamp, k, gd"""),
    "hspec": (("cells",), """SELECT timestamp, total, n82, n82 / nullif(total, 0) AS f82 FROM (SELECT timestamp,
          sum(coalesce(v, 0) * greatest(0, least(hi, log10(300::DOUBLE)) - greatest(lo, log10(15::DOUBLE)))) AS total,
          sum(coalesce(v, 0) * greatest(0, least(hi, log10(300::DOUBLE)) - greatest(lo, log10(82::DOUBLE)))) AS n82
        FROM cells GROUP BY timestamp)"""),
    "obs": (("good", "hspec"), """SELECT g.site, g.timestamp, g.target, h.total, h.n82, h.f82 FROM good g JOIN hspec h
        USING (timestamp) WHERE h.total > 0"""),
}


def sql(needs: str, body: str, **more: str) -> str:
    """``WITH`` the named expressions (and their needs, in order), then ``more``, then the body."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, text = CTES[name]
        for dep in deps:
            add(dep)
        done[name] = text

    for name in needs.split():
        add(name)
    done.update(more)
    head = ",\n".join(f"{n} AS ({t})" for n, t in done.items())
    return (f"WITH {head}\n" if done else "") + body.strip()


def query(name: str, oracle: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register
