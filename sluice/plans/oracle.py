"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from sluice.config import DEFAULT, MIX

EVENTS = "SELECT event_id AS seq, user_id AS key, CAST(round(value * 100) AS BIGINT) AS weight FROM events"
ORDERS = "SELECT o_orderkey AS seq, o_custkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS weight FROM orders"
LINEITEM = "SELECT l_partkey AS key, CAST(l_quantity AS BIGINT) AS weight FROM lineitem"


def _mul(m: int) -> str:
    return f"((xor(x, x >> 33))::UHUGEINT * {m}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def hashed(source: str, seeds: tuple[int, ...], mask: int, number: str, tag: str = "") -> str:
    """CTEs ending in p<tag>: source's columns, the hash's number, and col."""
    values = ", ".join(f"({i}, {s}::UBIGINT)" for i, s in enumerate(seeds))
    return f"""
    seeds{tag}(n, s) AS (VALUES {values}),
    src{tag} AS ({source}),
    a{tag} AS (SELECT src{tag}.*, n, xor(key::UBIGINT, s) AS x FROM src{tag}, seeds{tag}),
    b{tag} AS (SELECT * REPLACE ({_mul(MIX[0])} AS x) FROM a{tag}),
    d{tag} AS (SELECT * REPLACE ({_mul(MIX[1])} AS x) FROM b{tag}),
    p{tag} AS (SELECT * EXCLUDE (x, n), n::INTEGER AS "{number}", (xor(x, x >> 33) & {mask}::UBIGINT)::INTEGER AS col FROM d{tag})"""


def cms(source: str) -> str:
    return hashed(source, DEFAULT.cms_seeds, DEFAULT.columns - 1, "row")


def bloom(source: str) -> str:
    return hashed(source, DEFAULT.bloom_seeds, DEFAULT.bloom_columns - 1, "i", "8")


#: CTEs of the events' flow table, pattern, measurements and first correlations.
FLOWS = f"""{cms(EVENTS)},
    keys AS (SELECT key, min(seq) AS first, sum(weight)::DOUBLE AS true_x FROM src GROUP BY key),
    flows AS (SELECT row_number() OVER (ORDER BY first, key) - 1 AS flow_id, key, true_x FROM keys),
    pattern AS (SELECT DISTINCT flow_id, "row", ("row" * 16384 + col)::INTEGER AS pos FROM p JOIN flows USING (key)),
    y AS (SELECT ("row" * 16384 + col)::INTEGER AS pos, (sum(weight) % 4294967296)::DOUBLE AS value FROM p GROUP BY "row", col),
    corr AS (SELECT flow_id, sum(value) AS corr FROM pattern JOIN y USING (pos) GROUP BY flow_id),
    best AS (SELECT flow_id, corr FROM corr WHERE abs(corr) > 1e-9 ORDER BY abs(corr) DESC, flow_id LIMIT 1),
    heavy AS (SELECT pos, value FROM y WHERE abs(value) > (SELECT 0.1 * max(abs(value)) FROM y) ORDER BY abs(value) DESC, pos LIMIT 32),
    cand AS (SELECT DISTINCT flow_id FROM pattern JOIN heavy USING (pos)),
    step1 AS (SELECT flow_id, corr / 4 AS x FROM best),
    r1 AS (SELECT y.pos, value - coalesce(x, 0) AS value FROM y LEFT JOIN (SELECT pos, x FROM pattern JOIN step1 USING (flow_id)) USING (pos))"""


def solve(name: str, support: str, given: str, y: str = "y", rounds: int = 16) -> str:
    """CTEs ending in <name>: flow_id, x, the least squares of y on the flows of `support`, from the start values `given` (flow_id, x).

    Flows share few counters, so that adding a fourth of what is left at a flow's counters, again
    and again, settles fast.
    """
    out, last = [f"{name}_0 AS MATERIALIZED (SELECT flow_id, coalesce(x, 0)::DOUBLE AS x FROM {support} LEFT JOIN {given} USING (flow_id))"], f"{name}_0"
    out.append(f"{name}_a AS MATERIALIZED (SELECT flow_id, pos, value FROM pattern JOIN {support} USING (flow_id) JOIN {y} USING (pos))")
    for i in range(1, rounds + 1):
        left = f"SELECT pos, sum(x) AS sx FROM {name}_a JOIN {last} USING (flow_id) GROUP BY pos"
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT flow_id, max(x) + sum(value - sx) / 4 AS x FROM {name}_a JOIN ({left}) USING (pos) JOIN {last} USING (flow_id) GROUP BY flow_id)")
        last = f"{name}_{i}"
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT flow_id, x FROM {last})"])


def pursuit(steps: int) -> str:
    """CTEs ending in found: flow_id, x of the flows that so many steps of the pursuit take."""
    out = ["s0 AS MATERIALIZED (SELECT 0::BIGINT AS flow_id, 0::DOUBLE AS x WHERE false)", "r_0 AS MATERIALIZED (SELECT pos, value FROM y)"]
    for i in range(1, steps + 1):
        pick = f"SELECT flow_id FROM pattern JOIN r_{i - 1} USING (pos) WHERE flow_id NOT IN (SELECT flow_id FROM s{i - 1}) GROUP BY flow_id HAVING abs(sum(value)) > 1e-9 ORDER BY abs(sum(value)) DESC, flow_id LIMIT 1"
        out.append(f"u{i} AS MATERIALIZED (SELECT flow_id FROM s{i - 1} UNION ALL (SELECT flow_id FROM ({pick})))")
        out.append(solve(f"s{i}", f"u{i}", f"s{i - 1}", rounds=12))
        out.append(f"r_{i} AS MATERIALIZED (SELECT y.pos, value - coalesce(sx, 0) AS value FROM y LEFT JOIN (SELECT pos, sum(x) AS sx FROM pattern JOIN s{i} USING (flow_id) GROUP BY pos) USING (pos))")
    return ", ".join([*out, f"found AS (SELECT flow_id, x FROM s{steps})"])


def generated(distribution: str, n: int, seed: int) -> str:
    """SELECT of seq, key (as unsigned) and weight of generated packets."""
    from sluice.sources import generators

    a, b, c = generators.key_sql(seed)
    key = f"xor(xor((({a}) & 65535)::UBIGINT << 48, ({b})::UBIGINT << 16), (({c}) & 65535)::UBIGINT)"
    if distribution != "zipf":
        return f"SELECT id AS seq, {key} AS key, ({generators.weight_sql(distribution, n, seed)})::BIGINT AS weight FROM range({n}) g(id)"
    return f"""SELECT id AS seq, {key} AS key, floor(least(greatest(100000 / pow(rank::DOUBLE, 1.2), 1.0), 100000.0))::BIGINT AS weight
    FROM (SELECT id, {generators.random_sql("id", seed, 6)} / {generators.PRIME}.0::DOUBLE AS u FROM range({n}) g(id))
    JOIN (SELECT rank, high, coalesce(lag(high) OVER (ORDER BY rank), 0) AS low FROM (
      SELECT n AS rank, CASE WHEN n = 10000 THEN 1.0 ELSE sum(pow(n::DOUBLE, -1.2)) OVER (ORDER BY n) / sum(pow(n::DOUBLE, -1.2)) OVER () END AS high FROM range(1, 10001) z(n))) ON u > low AND u <= high"""
