"""Linear programs with few rows over any number of units: maximise the objective of allocations between bounds, with
bounds on the activity of rows.

A proximal method on the prices of the rows: given prices, each unit finds its own allocation
clip(centre + step * (objective - its priced coefficients)), so one pass over the units gives the value of the dual, its
slope and its curvature (sums of a few numbers a row and pair of rows), with which Newton's method improves the prices on
the driver. When they have settled, allocations become the new centre and the step grows, until activities keep the
bounds and the duality gap is closed. A centre is a function of the prices so far, which are sent along and applied
again; so the table of units is written once and no pass writes anything.

Several scenarios (other bounds for some units) are solved in the same passes. Rows are few by contract (ROWS); there
may be any number of units and nonzeros. Prices that prove the rows unattainable end a scenario as infeasible.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.shared import save

#: Most rows of a program: their prices, and what each two share, reach the driver.
ROWS = 200
#: Parts of a Newton step that a pass tries at once.
STEPS = (1.0, 0.6, 0.3, 0.1, 0.03, 0.01, 0.001)
#: Relative gap and violation of a solution.
CLOSED = 1e-10
#: Units that a replacement may change besides the one left out, before all units are asked again.
NEAR = 2048
#: The step that a program of them begins with.
STRIDE = 1e4


@dataclass
class Program:
    """columns: unit, objective, low, high, at (array of row numbers), coefs. Rows have a scale, so that all weigh alike."""

    columns: DataFrame
    names: list
    low: np.ndarray
    high: np.ndarray
    scale: np.ndarray
    size: float


@dataclass
class Scenario:
    """changed: (low, high) of units that differ from the table. Then what is known of its solution."""

    changed: dict = field(default_factory=dict)
    status: str = "open"
    objective: float | None = None
    bound: float | None = None
    activity: np.ndarray | None = None
    prices: np.ndarray | None = None
    past: list = field(default_factory=list)  # (prices, step) of the centres so far


def program(units: DataFrame, rows: DataFrame, nonzeros: DataFrame) -> Program:
    """units: unit, objective, and low and high (0 and 1 without them). rows: row_id, low, high; NULL, NaN or an infinity is no
    bound. nonzeros: row_id, unit, coef; entries of one row and unit add up, those of unknown rows and units count nothing."""
    found = rows.select("row_id", F.col("low").cast("double"), F.col("high").cast("double")).orderBy("row_id").limit(ROWS + 1).collect()
    if len(found) > ROWS:
        raise ValueError(f"more than {ROWS} rows")
    names = [r.row_id for r in found]
    finite = lambda x, other: other if x is None or not np.isfinite(x) else x
    low, high = np.array([finite(r.low, -np.inf) for r in found]), np.array([finite(r.high, np.inf) for r in found])
    numbers = units.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"row_id {rows.schema['row_id'].dataType.simpleString()}, at int")
    entries = nonzeros.join(F.broadcast(numbers), "row_id").groupBy("unit", "at").agg(F.sum(F.col("coef").cast("double")).alias("coef")).where("coef <> 0")
    entries = entries.groupBy("unit").agg(F.collect_list(F.struct("at", "coef")).alias("e"))  # at most ROWS a unit
    bounds = [F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in units.columns else F.lit(d) for c, d in (("low", 0.0), ("high", 1.0))]
    columns = units.select("unit", F.col("objective").cast("double").alias("objective"), bounds[0].alias("low"), bounds[1].alias("high")).join(entries.hint("merge"), "unit", "left")
    columns = save(columns.select("unit", "objective", "low", "high", F.coalesce("e.at", F.array().cast("array<int>")).alias("at"), F.coalesce("e.coef", F.array().cast("array<double>")).alias("coefs")))
    scale = np.ones(len(names))
    for r in columns.select(F.explode(F.arrays_zip("at", "coefs")).alias("e")).groupBy("e.at").agg(F.sqrt(F.sum(F.col("e.coefs") * F.col("e.coefs"))).alias("s")).collect():
        scale[r["at"]] = r.s or 1.0
    size = columns.agg(F.max(F.abs("objective"))).first()[0] or 1.0
    return Program(columns, names, low / scale, high / scale, scale, size)


class Block:
    """Units of a batch as matrices."""

    def __init__(self, batch: pa.RecordBatch, p_scale: np.ndarray, size: float):
        get = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64)
        self.c, self.low, self.high = get(1) / size, get(2), get(3)
        at, coefs = batch.column(4), batch.column(5)
        self.a = np.zeros((len(self.c), len(p_scale)))
        row = np.repeat(np.arange(len(self.c)), np.diff(at.offsets.to_numpy()))
        k = at.flatten().to_numpy()
        self.a[row, k] = coefs.flatten().to_numpy() / p_scale[k]
        self.place: dict | None = None
        self.units = batch.column(0)

    def beside(self, near: Block) -> Block:
        """The near units and then these, of which alone bounds change."""
        out = copy(near)
        out.c, out.low, out.high, out.a = (np.concatenate([getattr(b, k) for b in (near, self)]) for k in ("c", "low", "high", "a"))
        out.place = {u: len(near.c) + i for i, u in enumerate(self.units.to_pylist())}
        return out

    def bounds(self, changed: dict) -> tuple[np.ndarray, np.ndarray]:
        if not changed:
            return self.low, self.high
        if self.place is None:
            self.place = {u: i for i, u in enumerate(self.units.to_pylist())}
        low, high = self.low.copy(), self.high.copy()
        for u, (a, b) in changed.items():
            if u in self.place:
                low[self.place[u]], high[self.place[u]] = a, b
        return low, high

    def centre(self, past: list, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = np.clip(np.zeros(len(self.c)), low, high)
        for prices, step in past:
            x = np.clip(x + step * (self.c - self.a @ prices), low, high)
        return x


def _sums(b: Block, lane: tuple[dict, list, float, list[np.ndarray]], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What _pass() sums, for the units of a block and one lane: a line for each of its prices."""
    changed, past, step, tried = lane
    low, high = b.bounds(changed)
    centre = b.centre(past, low, high)
    out = []
    for y in tried:
        free = centre + step * (b.c - b.a @ y)
        x = np.clip(free, low, high)
        inner = b.a[(free > low) & (free < high)]
        s, v = b.c - b.a @ allowed(y, least, most), -(b.a @ y)
        out.append([b.c @ x, ((x - centre) ** 2).sum(), np.maximum(low * s, high * s).sum(), np.maximum(low * v, high * v).sum(), *(b.a.T @ x), *(inner.T @ inner).reshape(-1)])
    return np.array(out)


def _pass(p: Program, lanes: list[tuple[dict, list, float, list[np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all units for each lane (changed bounds, past, step, prices to try) and its prices: objective, squared way
    from the centre, dual value of the units, value along a ray, activities, curvature."""
    m = len(p.names)
    shared = p.columns.sparkSession.sparkContext.broadcast((lanes, p.scale, p.size, p.low, p.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, scale, size, least, most = shared.value
        sums = [np.zeros((len(tried), 4 + m + m * m)) for *_, tried in lanes]
        for batch in batches:
            b = Block(batch, scale, size)
            for k, lane in enumerate(lanes):
                sums[k] += _sums(b, lane, least, most)
        rows = [(k, t, i, v) for k, of in enumerate(sums) for t, values in enumerate(of.tolist()) for i, v in enumerate(values)]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["k", "t", "i", "v"])

    out = {(k, t): np.zeros(4 + m + m * m) for k, lane in enumerate(lanes) for t in range(len(lane[3]))}
    for r in p.columns.mapInArrow(run, "k int, t int, i int, v double").groupBy("k", "t", "i").agg(F.sum("v").alias("v")).collect():
        out[r.k, r.t][r.i] = r.v
    return out


def allowed(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Prices without those that only a bound that isn't there could have."""
    return np.where(((y > 0) & np.isinf(high)) | ((y < 0) & np.isinf(low)), 0.0, y)


def _support(y: np.ndarray, p: Program) -> float:
    """The most that activities within the bounds are worth at these prices."""
    return float((y[y > 0] @ p.high[y > 0]) + (y[y < 0] @ p.low[y < 0]))


class _Search:
    """Newton's method for one scenario: what to try next, given what a pass found."""

    def __init__(self, p: Program, scenario: Scenario, start: np.ndarray | None, step: float = 1.0):
        self.p, self.s = p, scenario
        self.y = np.zeros(len(p.names)) if start is None else start
        self.step, self.rows = step, np.clip(np.zeros(len(p.names)), p.low, p.high)
        self.tried, self.value, self.slope, self.rounds, self.gap = [self.y], None, None, 0, 1.0

    def lane(self) -> tuple[dict, list, float, list[np.ndarray]]:
        return self.s.changed, self.s.past, self.step, self.tried

    def worth(self, y: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual value at y, its slope, and the activities that the rows would like."""
        m = len(y)
        activity, free = sums[4 : 4 + m], self.rows + self.step * y
        r = np.clip(free, self.p.low, self.p.high)
        value = sums[0] - sums[1] / (2 * self.step) - y @ activity + y @ r - ((r - self.rows) ** 2).sum() / (2 * self.step)
        return value, r - activity, r

    def infeasible(self, y: np.ndarray, ray: float) -> bool:
        """Whether prices along y fall without end: no allocation meets the rows that y weighs."""
        norm = np.abs(y).max(initial=0.0)
        if norm < 1e3:
            return False
        clean = np.where(np.abs(y) < 1e-6 * norm, 0.0, y)
        if not np.array_equal(allowed(clean, self.p.low, self.p.high), clean):
            return False
        return (ray + _support(clean, self.p)) / norm < -1e-9

    def tell(self, found: list[np.ndarray]) -> None:
        worths = [self.worth(y, f) for y, f in zip(self.tried, found, strict=True)]
        if self.value is None:
            k = 0
        else:
            noise = 1e-13 * (1 + abs(self.value))
            good = [j for j, w in enumerate(worths) if w[0] <= self.value + 1e-4 * STEPS[j] * self.part * self.fall + noise]
            if not good and self.part > 1e-9:  # nearer to where it came from
                self.part, self.rounds = self.part * STEPS[-1], self.rounds + 1
                self.tried = [self.y + self.part * t * self.move for t in STEPS]
                return
            k = min(good or range(len(worths)), key=lambda j: (worths[j][0] if worths[j][0] < self.value - noise else self.value, np.abs(worths[j][1]).max()))
        self.y, (self.value, slope, r), sums = self.tried[k], worths[k], found[k]
        self.rounds += 1
        m = len(self.y)
        if self.infeasible(self.y, sums[3]):
            self.s.status = "infeasible"
            return
        size, off = 1 + np.abs(r).max(initial=0.0), np.abs(slope).max(initial=0.0)
        if off > max(CLOSED / 10, min(1e-5, 1e-3 * self.gap)) * size and self.rounds < 25:
            wide = (self.rows + self.step * self.y > self.p.low) & (self.rows + self.step * self.y < self.p.high)
            curve = self.step * (sums[4 + m :].reshape(m, m) + np.diag(wide.astype(float)) + np.eye(m) * (1e-2 * min(0.1, off) + 1e-14))
            move = np.linalg.solve(curve, -slope)
            self.fall, self.move, self.part, self.tried = float(slope @ move), move, 1.0, [self.y + t * move for t in STEPS]
            return
        settled = self.rounds < 25
        activity = sums[4 : 4 + m]
        best = allowed(self.y, self.p.low, self.p.high)
        bound = sums[2] + _support(best, self.p)
        broken = np.maximum(np.maximum(self.p.low - activity, activity - self.p.high), 0).max(initial=0.0)
        self.gap = abs(bound - sums[0]) / (1 + abs(bound))
        self.s.past = [*self.s.past, (self.y, self.step)]
        self.s.objective, self.s.bound = float(sums[0] * self.p.size), float(bound * self.p.size)
        self.s.activity, self.s.prices = activity * self.p.scale, self.y * self.p.size / self.p.scale
        if broken <= CLOSED * size and self.gap <= CLOSED:
            self.s.status = "optimal"
        elif len(self.s.past) > 40:
            self.s.status = "unsettled"
        self.rows, self.step, self.tried, self.value, self.rounds = r, min(self.step * 6, 1e7) if settled else self.step / 2, [self.y], None, 0


def solve(p: Program, scenarios: Sequence[dict] = ({},), start: np.ndarray | None = None, together: int = 64) -> list[Scenario]:
    """The solutions of the scenarios, so many at once in each pass. start: prices to begin with (of a similar program)."""
    found = [Scenario(dict(s)) for s in scenarios]
    scaled = None if start is None else start * p.scale / p.size
    for a in range(0, len(found), together):
        searches = [_Search(p, s, scaled) for s in found[a : a + together]]
        while open_ones := [s for s in searches if s.s.status == "open"]:
            sums = _pass(p, [s.lane() for s in open_ones])
            for k, s in enumerate(open_ones):
                s.tell([sums[k, t] for t in range(len(s.tried))])
    return found


def allocations(p: Program, scenario: Scenario, name: str = "x") -> DataFrame:
    """unit, objective, low, high and the allocation of a solved scenario."""
    kind = p.columns.schema["unit"].dataType.simpleString()
    shared = p.columns.sparkSession.sparkContext.broadcast((scenario.changed, scenario.past, p.scale, p.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed, past, scale, size = shared.value
        for batch in batches:
            b = Block(batch, scale, size)
            low, high = b.bounds(changed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low), pa.array(high), pa.array(b.centre(past, low, high))], ["unit", "objective", "low", "high", name])

    return p.columns.mapInArrow(run, f"unit {kind}, objective double, low double, high double, {name} double")


def priority(units: DataFrame, rows: DataFrame, nonzeros: DataFrame, shares: Sequence[float]) -> DataFrame:
    """unit, priority and the allocations of all budgets (array), least budget first: the mean allocation over nested budgets.

    Each budget (a share of the number of units) must be spent to the full within the rows, and no unit falls below what a
    smaller budget gave it. A budget that can't be met raises.
    """
    shares = [float(s) for s in shares]
    if not shares or any(not 0 < s <= 1 for s in shares) or any(b <= a for a, b in zip(shares, shares[1:], strict=False)):
        raise ValueError("shares must rise within (0, 1]")
    kind = rows.schema["row_id"].dataType.simpleString()
    bounds = [F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in units.columns else F.lit(d) for c, d in (("low", 0.0), ("high", 1.0))]
    units = save(units.select("unit", "objective", bounds[0].alias("low"), bounds[1].alias("high")))
    n, nonzeros = units.count(), save(nonzeros.select("row_id", "unit", "coef"))
    at = nonzeros.sparkSession.range(1).select(F.lit(None).cast(kind).alias("row_id"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    numbered = rows.select(F.struct(F.lit(1).alias("k"), "row_id").alias("row_id"), F.col("low").cast("double"), F.col("high").cast("double"))
    entries = nonzeros.select(F.struct(F.lit(1).alias("k"), "row_id").alias("row_id"), "unit", F.col("coef").cast("double").alias("coef"))
    ones = units.select(F.struct(F.lit(0).alias("k"), F.lit(None).cast(kind).alias("row_id")).alias("row_id"), "unit", F.lit(1.0).alias("coef"))
    target = at.select(F.struct(F.lit(0).alias("k"), "row_id").alias("row_id"), "low", "high")
    p = program(units, _keyed(target.unionByName(numbered)), _keyed(entries.unionByName(ones)))  # the target is row 0
    prices, given, columns = None, units.select("unit", F.array().cast("array<double>").alias("given")), p.columns
    for share in shares:
        p = Program(columns, p.names, p.low.copy(), p.high.copy(), p.scale, p.size)
        p.low[0] = p.high[0] = share * n / p.scale[0]
        found = solve(p, start=prices)[0]
        if found.status != "optimal":
            raise ValueError(f"budget {share:g} of the units is {found.status}")
        prices = found.prices
        x = save(allocations(p, found).select("unit", "x"))
        columns = save(columns.join(x.hint("merge"), "unit").select("unit", "objective", F.greatest(F.col("low"), F.least("x", "high")).alias("low"), "high", "at", "coefs"))
        given = given.join(x.hint("merge"), "unit").select("unit", F.array_append("given", F.col("x")).alias("given"))
    mean = F.aggregate("given", F.lit(0.0), lambda a, b: a + b) / len(shares)
    return given.select("unit", mean.alias("priority"), "given")


def _keyed(df: DataFrame) -> DataFrame:
    """df with row ids as text in the order of (k, row_id)."""
    return df.withColumn("row_id", F.concat_ws(":", F.col("row_id.k"), F.col("row_id.row_id").cast("string")))


def _placed(p: Program, best: Scenario) -> DataFrame:
    """The columns of a program with x, the solution's allocations, held (the bound that a unit is held to by the sign of what the
    prices leave of its objective) and reach: the least change of any price that can turn this sign; NULL: none can."""
    y = best.prices * p.scale / p.size
    shared = p.columns.sparkSession.sparkContext.broadcast((best.past, y, p.scale, p.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, y, scale, size = shared.value
        for batch in batches:
            b = Block(batch, scale, size)
            left, weight = b.c - b.a @ y, np.abs(b.a).sum(axis=1)
            reach = np.divide(np.abs(left), weight, out=np.full(len(left), np.inf), where=weight > 0)
            new = [b.centre(past, b.low, b.high), np.where(left > 0, b.high, b.low)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new), pa.array(reach, mask=np.isinf(reach))], [*batch.schema.names, "x", "held", "reach"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.columns.schema.fields)
    return p.columns.mapInArrow(run, f"{fields}, x double, held double, reach double")


def _without_each(p: Program, best: Scenario, placed: DataFrame, used: DataFrame) -> DataFrame:
    """unit, loss of the units used, each left out alone; NULL where it takes all units to tell.

    Without one unit prices change little, and only units whose sign turns change with them. So each unit is left out of a
    program of the NEAR units of least reach, with all others held where they are. Its solution is one of the whole program if
    its prices moved by less than the reach of all that are held: then none of those would leave its bound. One task a part of
    the units; the near ones are sent to all. Losses are differences of what the prices prove, which is exact to the second order.
    """
    near = placed.where("reach IS NOT NULL").orderBy("reach", "unit").limit(NEAR + 1).toArrow()
    reach = near.column("reach")[NEAR].as_py() if near.num_rows > NEAR else np.inf
    near = near.slice(0, NEAR).combine_chunks()
    names = placed.columns
    batch = near.to_batches()[0] if near.num_rows else pa.RecordBatch.from_pylist([], near.schema)
    weight = np.sqrt((Block(batch, p.scale, p.size).a ** 2).sum(axis=0))  # rows are scaled anew, by the near units
    weight = np.where(weight > 0, weight, 1.0)
    names_of_rows, scale, size, p_low, p_high = p.names, p.scale * weight, p.size, p.low / weight, p.high / weight
    fixed = np.zeros(len(p.names))
    for r in placed.select("held", F.explode(F.arrays_zip("at", "coefs")).alias("e")).groupBy("e.at").agg(F.sum(F.col("held") * F.col("e.coefs")).alias("s")).collect():  # at most ROWS
        fixed[r["at"]] = r.s / scale[r["at"]]
    block = Block(batch, scale, size)
    fixed -= block.a.T @ batch.column(names.index("held")).to_numpy()
    prices, unit_price = best.prices, p.scale / size

    def solved(rest: np.ndarray, block: Block, changed: dict) -> Scenario:
        local, found = Program(None, names_of_rows, p_low - rest, p_high - rest, scale, size), Scenario(changed)
        search = _Search(local, found, prices * scale / size, STRIDE)
        while found.status == "open":
            search.tell(list(_sums(block, search.lane(), local.low, local.high)))
        return found

    sure = lambda s: s.status == "optimal" and bool(np.all(np.abs(s.prices - prices) * unit_price < reach))
    whole = solved(fixed, block, {})
    base = whole.bound if sure(whole) else None
    shared = placed.sparkSession.sparkContext.broadcast((batch, fixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, fixed = shared.value
        block = Block(near, scale, size)
        places = set(near.column(0).to_pylist())
        for asked in batches:
            losses: list[float | None] = []
            held = asked.column(names.index("held")).to_numpy()
            for i, u in enumerate(asked.column(0).to_pylist()):
                if base is None:
                    losses.append(None)
                    continue
                own = Block(asked.slice(i, 1), scale, size)
                among, before, rest = block, base, fixed
                if u not in places:
                    among, before, rest = own.beside(block), base + float(own.c[0]) * size * held[i], fixed - own.a[0] * held[i]
                found = solved(rest, among, {u: (min(own.low[0], 0.0), 0.0)})
                losses.append(max(before - found.bound, 0.0) if sure(found) else None)
            yield pa.RecordBatch.from_arrays([asked.column(0), pa.array(losses, pa.float64())], ["unit", "loss"])

    return used.select(*names).mapInArrow(run, f"unit {placed.schema['unit'].dataType.simpleString()}, loss double")


def replacement(units: DataFrame, rows: DataFrame, nonzeros: DataFrame, asked: DataFrame | None = None, most: int | None = 100) -> DataFrame:
    """unit, x, status (replaceable or absolutely_irreplaceable), objective (of the best without the unit), loss and
    relative_loss of the units asked for (unit; all without it).

    A unit that the best solution does without loses nothing and needs no solution of its own. All others, `most` at most
    (None: any number), are solved from the best one's prices, in tasks where that can be shown to be enough, else over all
    units side by side. Without any solution the program raises.
    """
    p = program(units, rows, nonzeros)
    best = solve(p)[0]
    if best.status != "optimal":
        raise ValueError(f"the program is {best.status}")
    placed = save(_placed(p, best))
    wanted = placed if asked is None else placed.join(asked.select("unit").distinct().hint("merge"), "unit", "left_semi")
    used = save(wanted.where(F.col("x") > F.col("low") + 1e-7))
    n = used.count()
    if most is not None and n > most:
        raise ValueError(f"more than {most} units to exclude")
    kind = placed.schema["unit"].dataType.simpleString()
    losses = save(_without_each(p, best, placed, used.repartition(max(1, -(-n // 64)), "unit")))
    rest = losses.where("loss IS NULL").join(used.select("unit", "low").hint("merge"), "unit").select("unit", "low").collect()
    found = solve(p, [{r.unit: (min(r.low, 0.0), 0.0)} for r in rest], best.prices * 1.0)
    done = [(r.unit, s.status, s.objective) for r, s in zip(rest, found, strict=True)]
    if unsettled := [u for u, status, _ in done if status == "unsettled"]:
        raise ValueError(f"no solution within the tolerance without {unsettled[:5]}")
    others = units.sparkSession.createDataFrame([(u, status == "infeasible", None if status == "infeasible" else max(best.objective - z, 0.0)) for u, status, z in done], f"unit {kind}, infeasible boolean, loss double")
    solved = losses.where("loss IS NOT NULL").select("unit", F.lit(False).alias("infeasible"), "loss").unionByName(others)
    out = wanted.select("unit", "x").join(solved.hint("merge"), "unit", "left")
    alone = F.coalesce("infeasible", F.lit(False))
    loss = F.when(~alone, F.coalesce("loss", F.lit(0.0)))
    status = F.when(alone, "absolutely_irreplaceable").otherwise("replaceable")
    relative = F.when(F.lit(abs(best.objective) > 0), loss / abs(best.objective or 1.0))
    return out.select("unit", "x", status.alias("status"), (F.lit(best.objective) - loss).alias("objective"), loss.alias("loss"), relative.alias("relative_loss"))
