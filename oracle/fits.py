"""Linear fits in SQL: sums of products, solved by elimination, for the twins of fitted queries."""

from __future__ import annotations


def _solve(source: str, n: int, name: str) -> tuple[list[tuple[str, str]], str]:
    """Gauss-Jordan elimination of the one-row table ``source`` with a0_0 .. and g0 ..

    Gives the CTEs and the name of the last, whose columns x0 .. x(n-1) solve a x = g.
    """
    out, before = [], source
    for m in range(n):
        row = {f"a{m}_{j}": f"a{m}_{j} / a{m}_{m}" for j in range(m, n)} | {f"g{m}": f"g{m} / a{m}_{m}"}
        for i in range(n):
            if i != m:
                row |= {f"a{i}_{j}": f"a{i}_{j} - a{i}_{m} * (a{m}_{j} / a{m}_{m})" for j in range(m + 1, n)}
                row[f"g{i}"] = f"g{i} - a{i}_{m} * (g{m} / a{m}_{m})"
        kept = [k for i in range(n) for k in (*(f"a{i}_{j}" for j in range(m + 1, n)), f"g{i}")]
        out.append((f"{name}_e{m}", "select " + ", ".join(f"{row[k]} as {k}" for k in kept) + f" from {before}"))
        before = f"{name}_e{m}"
    out.append((f"{name}_x", "select " + ", ".join(f"g{i} as x{i}" for i in range(n)) + f" from {before}"))
    return out, f"{name}_x"


def _inputs(source: str, features: tuple[str, ...], target: str, name: str) -> list[tuple[str, str]]:
    """Moments, and the rows as z0 = 1, z1 .. zn, y."""
    moments = ", ".join(f"avg(cast({f} as double)) as m{i}, stddev_pop(cast({f} as double)) + 1e-9 as s{i}" for i, f in enumerate(features, 1))
    rows = ", ".join(f"({f} - m{i}) / s{i} as z{i}" for i, f in enumerate(features, 1))
    return [
        (f"{name}_m", f"select {moments} from ({source}) q"),
        (f"{name}_z", f"select 1.0e0 as z0, {rows}, cast({target} as double) as y from ({source}) q, {name}_m"),
    ]


def ridge(source: str, features: tuple[str, ...], target: str, name: str) -> tuple[list[tuple[str, str]], str]:
    """CTEs, and a table of the weights x0 .. on standardised inputs; penalty 1 but for the intercept."""
    n = len(features) + 1
    ctes = _inputs(source, features, target, name)
    sums = [f"sum(z{i} * z{j}){' + 1.0e0' if i == j and i else ''} as a{i}_{j}" for i in range(n) for j in range(n)]
    ctes.append((f"{name}_s", "select " + ", ".join(sums + [f"sum(z{i} * y) as g{i}" for i in range(n)]) + f" from {name}_z"))
    solved, last = _solve(f"{name}_s", n, name)
    return ctes + solved, last


def logit(source: str, features: tuple[str, ...], target: str, name: str, steps: int = 8) -> tuple[list[tuple[str, str]], str]:
    """CTEs, and a table of the weights after so many Newton steps from zero."""
    n = len(features) + 1
    ctes = _inputs(source, features, target, name)
    before = f"{name}_w0"
    ctes.append((before, "select " + ", ".join(f"0.0e0 as x{i}" for i in range(n))))
    for k in range(1, steps + 1):
        odds = " + ".join(f"z{i} * x{i}" for i in range(n))
        ctes.append((f"{name}_p{k}", f"select q.*, 1.0e0 / (1.0e0 + exp(-({odds}))) as p from {name}_z q, {before}"))
        sums = [f"sum(p * (1 - p) * z{i} * z{j}){' + 1e-6' if i == j else ''} as a{i}_{j}" for i in range(n) for j in range(n)]
        ctes.append((f"{name}_s{k}", "select " + ", ".join(sums + [f"sum(z{i} * (y - p)) as g{i}" for i in range(n)]) + f" from {name}_p{k}"))
        solved, moved = _solve(f"{name}_s{k}", n, f"{name}_{k}")
        ctes += solved
        ctes.append((f"{name}_w{k}", "select " + ", ".join(f"b.x{i} + d.x{i} as x{i}" for i in range(n)) + f" from {before} b, {moved} d"))
        before = f"{name}_w{k}"
    return ctes, before


def boosted(source: str, held: str, features: tuple[str, ...], target: str, name: str, rounds: int, depth: int, cuts: int, rate: float) -> tuple[list[tuple[str, str]], str]:
    """CTEs of boosted trees on inputs cut at equal widths, and the last table: all rows with their ``score`` (log-odds).

    Trees grow on the rows that are not held out. Gradients are whole multiples of 2^-24, as in the fit.
    """
    n, unit = len(features), "16777216.0e0"
    ranges = ", ".join(f"min(cast({f} as double)) as lo{i}, max(cast({f} as double)) as hi{i}" for i, f in enumerate(features))
    bins = ", ".join(
        f"case when {f} is null then 63 else " + " + ".join(f"cast(lo{i} + (hi{i} - lo{i}) * {j} / {cuts + 1}.0e0 < {f} as int)" for j in range(1, cuts + 1)) + f" end as b{i}"
        for i, f in enumerate(features)
    )
    out = [
        (f"{name}_r", f"select avg(cast({target} as double)) as rate, {ranges} from ({source}) q where not ({held})"),
        (f"{name}_0", f"select q.*, {bins}, cast({target} as double) as y, ln(rate / (1 - rate)) as score, {held} as out from ({source}) q, {name}_r"),
    ]
    numbers, places = ", ".join(map(str, range(n))), ", ".join(f"b{i}" for i in range(n))
    for k in range(1, rounds + 1):
        at = f"{name}_{k}_g"
        slopes = f"select *, 1.0e0 / (1.0e0 + exp(-score)) as p from {name}_{k - 1}"
        whole = lambda x: f"case when out then 0 else round_even(({x}) * {unit}, 0) end"
        out.append((f"{name}_{k}_p", f"select *, {whole('p - y')} as g, {whole('p * (1.0e0 - p)')} as h, 0 as node from ({slopes}) s"))
        out.append((at, f"select q.*, -{rate}e0 * tg / (th + 1.0e0) as val from {name}_{k}_p q, (select sum(g) / {unit} as tg, sum(h) / {unit} as th from {name}_{k}_p) t"))
        for level in range(depth):
            last, at = at, f"{name}_{k}_{level}"
            out += [
                (f"{at}_h", f"""select node, f, bin, sum(g) / {unit} as g, sum(h) / {unit} as h from (
                    select node, g, h, unnest([{numbers}]) as f, unnest([{places}]) as bin from {last} where node >= {2**level - 1}) q group by all"""),
                (f"{at}_c", f"""select *, sum(g) over (partition by node, f) as tg, sum(h) over (partition by node, f) as th,
                    sum(case when bin < 63 then g end) over w as cg, sum(case when bin < 63 then h end) over w as ch,
                    coalesce(sum(case when bin = 63 then g end) over (partition by node, f), 0) as mg, coalesce(sum(case when bin = 63 then h end) over (partition by node, f), 0) as mh
                    from {at}_h window w as (partition by node, f order by bin)"""),
                (f"{at}_s", f"select node, f, bin, side, tg, th, cg + side * mg as lg, ch + side * mh as lh from {at}_c, (select unnest([0, 1]) as side) q where bin < 63"),
                (f"{at}_w", f"""select *, lg * lg / (lh + 1.0e0) + (tg - lg) * (tg - lg) / ((th - lh) + 1.0e0) - tg * tg / (th + 1.0e0) as gain
                    from {at}_s where lh >= 1 and th - lh >= 1"""),
                (f"{at}_d", f"""select * from (select *, row_number() over (partition by node order by gain desc, f, bin, side) as pick from {at}_w) q
                    where pick = 1 and gain > 1e-6"""),
                (f"{at}_m", f"select r.* exclude (node, val), r.node as was, val as had, d.f as f, d.side, d.bin as cut, lg, lh, tg, th, [{places}][d.f + 1] as mine from {last} r left join {at}_d d on d.node = r.node"),
                (at, f"""select * exclude (was, had, f, side, cut, lg, lh, tg, th, mine, is_left), case when f is null then was when is_left then 2 * was + 1 else 2 * was + 2 end as node,
                    case when f is null then had when is_left then -{rate}e0 * lg / (lh + 1.0e0) else -{rate}e0 * (tg - lg) / ((th - lh) + 1.0e0) end as val
                    from (select *, case when mine = 63 then side = 1 else mine <= cut end as is_left from {at}_m) q"""),
            ]
        out.append((f"{name}_{k}", f"select * exclude (p, g, h, node, val) replace (score + val as score) from {at}"))
    return out, f"{name}_{rounds}"
