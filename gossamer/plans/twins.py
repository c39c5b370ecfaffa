"""SQL of what needs more than a line of it: Murmur3, the ring, and gates whose every decision hangs on the ones before."""

from __future__ import annotations

_MASK = "4294967295::UBIGINT"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _rotated(x: str, bits: int) -> str:
    return f"(((({x}) << {bits}) & {_MASK}) | (({x}) >> {32 - bits}))"


def murmur3(text: str, seed: str = "0") -> str:
    """Unsigned 32-bit Murmur3 of a text's UTF-8 bytes; null stays null."""
    times = lambda x, c: f"((({x}) * {c}::UBIGINT) & {_MASK})"
    mixed = lambda k: times(_let(times(k, 0xCC9E2D51), "q", _rotated("q", 15)), 0x1B873593)
    shifted = lambda x, bits: _let(x, "s", f"xor(s, s >> {bits})")
    word = "(b[4 * j + 1] | (b[4 * j + 2] << 8) | (b[4 * j + 3] << 16) | (b[4 * j + 4] << 24))"
    words = f"list_transform(range(0, len(b) // 4), lambda j: {word})"
    step = _let(f"xor(h, {mixed('k')})", "r", f"((({_rotated('r', 13)}) * 5 + {0xE6546B64}::UBIGINT) & {_MASK})")
    body = f"list_reduce({words}, lambda h, k: {step}, ({seed})::UBIGINT)"
    rest = "list_reduce(list_transform(range(0, len(b) % 4), lambda j: b[4 * (len(b) // 4) + 1 + j] << (8 * j)::UBIGINT), lambda x, y: x | y, 0::UBIGINT)"
    tail = f"CASE WHEN len(b) % 4 > 0 THEN {mixed(rest)} ELSE 0::UBIGINT END"
    last = shifted(times(shifted(times(shifted(f"xor(xor({body}, {tail}), len(b)::UBIGINT)", 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)
    data = "list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT)"
    return f"CASE WHEN {text} IS NOT NULL THEN {_let(f'hex(encode({text}))', 'x', _let(data, 'b', last))}::BIGINT END"


def bloom_places(text: str, bits: int, hashes: int) -> str:
    """Places of a text in a Bloom filter, joined by commas."""
    places = f"array_to_string(list_transform(range(0, {hashes}), lambda n: (a + n * c) % {bits}), ',')"
    return f"CASE WHEN {text} IS NOT NULL THEN {_let(murmur3(text), 'a', _let(f'({murmur3(text, chr(97))}) | 1', 'c', places))} END"


def ring(nodes: list[str], virtual: int = 150) -> str:
    """(point, node): of equal points the node added last owns it."""
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(nodes))
    return f"SELECT point, arg_max(node, pos) AS node FROM (SELECT {murmur3(chr(39).join(['node || ', '#', ' || v::VARCHAR']))} AS point, node, pos FROM (VALUES {names}) n(pos, node), range({virtual}) r(v)) GROUP BY 1"


def owned(keys: str, key: str, nodes: list[str]) -> str:
    """(key, node): the node of the first point after each key's hash, around the end the first."""
    return f"""SELECT k.{key}, coalesce(p.node, (SELECT arg_min(node, point) FROM ({ring(nodes)}))) AS node
        FROM (SELECT {key}, {murmur3(key)} AS h FROM ({keys})) k ASOF LEFT JOIN ({ring(nodes)}) p ON p.point > k.h"""


def folded(rows: str, key: str, order: str, item: str, start: str, step: str, columns: str) -> str:
    """``columns`` over ``rows`` with ``s``: the state after folding ``step`` (of state a and item c) over a key's items before this row in
    ``order``; ``item`` a struct of the state's type, ``start`` the state before the first, which may use xs, the items up to this row."""
    return f"""SELECT {columns} FROM (SELECT *, list_reduce(xs[1:len(xs) - 1], lambda a, c: {step}, {start}) AS s
        FROM (SELECT *, list({item}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM ({rows})))"""


def strict_budget(rows: str, key: str, order: str, cost: str, limit: int) -> str:
    """A budget that a denied request doesn't charge."""
    charged = f"CASE WHEN s + {cost} <= {limit} THEN s + {cost} ELSE s END"
    return folded(rows, key, order, cost, "0", f"CASE WHEN a + c <= {limit} THEN a + c ELSE a END", f"{key}, {order}, s + {cost} <= {limit} AS allowed, greatest(0, {limit} - {charged})::BIGINT AS remaining")


def token_bucket(rows: str, key: str, order: str, now_ms: str, capacity: float, rate: float) -> str:
    """A token bucket of which each request wants one."""
    filled = lambda tokens, then, now: f"least({capacity}::DOUBLE, {tokens} + greatest(0::DOUBLE, {now} - {then}) / 1000::DOUBLE * {rate}::DOUBLE)"
    mid = filled("a.tokens", "a.moment", "c.moment")
    step = f"{{'tokens': CASE WHEN {mid} >= 1 THEN {mid} - 1 ELSE {mid} END, 'moment': c.moment}}"
    here = filled("s.tokens", "s.moment", now_ms)
    return folded(
        rows, key, order, f"{{'tokens': 0::DOUBLE, 'moment': {now_ms}}}", f"{{'tokens': {capacity}::DOUBLE, 'moment': xs[1].moment}}", step,
        f"{key}, {order}, {here} >= 1 AS allowed, CASE WHEN {here} >= 1 THEN 0 ELSE ceil((1 - {here}) / {rate}::DOUBLE * 1000) END::BIGINT AS wait_ms",
    )


def breaker(rows: str, key: str, order: str, seconds: str, failed: str, threshold: int, reset: float) -> str:
    """A circuit breaker: whether each request passes, and the breaker's state after it."""

    def after(a: str, now: str, bad: str) -> str:
        closed = "{'mode': 'closed', 'failures': 0, 'opened': " + f"{a}.opened, 'now': {now}, 'bad': {bad}" + "}"
        opened = f"{{'mode': 'open', 'failures': {a}.failures, 'opened': {now}, 'now': {now}, 'bad': {bad}}}"
        more = f"{{'mode': CASE WHEN {a}.failures + 1 >= {threshold} THEN 'open' ELSE 'closed' END, 'failures': {a}.failures + 1, 'opened': CASE WHEN {a}.failures + 1 >= {threshold} THEN {now} ELSE {a}.opened END, 'now': {now}, 'bad': {bad}}}"
        waits = f"{a}.mode = 'open' AND {now} - {a}.opened < {reset}"
        return f"CASE WHEN {waits} THEN {a} WHEN NOT {bad} THEN {closed} WHEN {a}.mode = 'open' THEN {opened} ELSE {more} END"

    start = "{'mode': 'closed', 'failures': 0, 'opened': 0::DOUBLE, 'now': 0::DOUBLE, 'bad': false}"
    item = f"{{'mode': 'closed', 'failures': 0, 'opened': 0::DOUBLE, 'now': {seconds}, 'bad': {failed}}}"
    return folded(
        rows, key, order, item, start, after("a", "c.now", "c.bad"),
        f"{key}, {order}, NOT (s.mode = 'open' AND {seconds} - s.opened < {reset}) AS allowed, ({after('s', seconds, failed)}).mode AS state",
    )


def latency_quantiles(rows: str, time: str, value: str, buckets: tuple[float, ...], width: str) -> str:
    """Quantiles per window from cumulative bucket counts, linear inside a bucket."""
    counts = ", ".join(f"count_if({value} <= {b}) AS le_{i}" for i, b in enumerate(buckets))

    def quantile(q: float) -> str:
        cases = []
        for i, high in enumerate(buckets):
            low, below = (buckets[i - 1], f"le_{i - 1}") if i else (0.0, "0")
            cases.append(f"WHEN le_{i} >= n * {q}::DOUBLE THEN {low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * CASE WHEN le_{i} > {below} THEN (n * {q}::DOUBLE - {below}) / (le_{i} - {below}) ELSE 0 END")
        return f"CASE WHEN n > 0 THEN CASE {' '.join(cases)} ELSE {buckets[-1]}::DOUBLE END END"

    picks = ", ".join(f"{quantile(q)} AS {name}" for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
    return f"SELECT window_end, n, {picks} FROM (SELECT time_bucket(INTERVAL '{width}', {time}, TIMESTAMP '1970-01-01') + INTERVAL '{width}' AS window_end, count({value}) AS n, {counts} FROM {rows} GROUP BY 1)"
