"""One-to-one matches of large batches by an auction that is spread over tasks.

The cells of the smaller batch of a pair bid for those of the larger one. A bidder sees the k objects of least cost plus
price, found by a blocked join, and a bound below which no other object can lie; as prices only rise, the bound stays true,
and a list is fetched anew (with the prices of the day) only when its best entry has risen above it. Bidders are dealt into
regions, by the nearest of a few drawn pivots. A task runs the auction among the bidders of its region with the prices it
was given, until each holds an object or needs a new list. Then every object goes to its highest bid of all regions, and
who lost one bids again. A price is never below what any task saw, so each holder is within epsilon of its best object at
the end, and the total cost is at most n * epsilon above the least one. With epsilon = slack * (mean least cost) the total is
at most 1 + slack times the least total, where costs are not negative.

Where both batches have as many cells, all objects are taken in the end and any prices may be started from: epsilon then
falls in steps from a fourth of the spread of costs, which ends wars over prices between regions early. With unequal sizes an
object that nobody takes has to keep the price 0, so the last epsilon is used from the start.

A pair of at most NEAR objects is one region (unless a caller asks for smaller ones): its first lists come from the blocked
join over all tasks, and one task then bids for many bidders at a time and makes the few new lists itself, from the vectors of
the pair. Objects of equal vectors are one good with several units there: a bid passes the best other good, not the next copy.

Beyond that, a new list is another round. Rounds are written to the shared folder; a task holds one region (its lists and the
prices of the objects in them, and at most NEAR vectors) or one pair of blocks. The regions are drawn in several ways that take
turns, so that a border between two of them does not stay one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.knn import BLOCK, GRID, LARGE, distances, exact

#: Objects of a bidder's list, bidders of a region, ways to draw regions, pivots at most, objects of the longer lists together.
LISTED, REGION, TURNS, MAX_PIVOTS, MORE = 128, 40_000, 3, 1_024, 4_000_000
#: Objects of a pair that are sent to a region's task as they are, and those of a list that it makes of them.
NEAR, FETCHED = 1 << 18, 512
#: Factor between the steps of epsilon.
FALL = 10.0
#: Objects of a first list in a pair that is one region, bidders that bid at a time, and that are given new lists at a time.
SHORT, BIDS, ASKED = 128, 2_048, 256
#: Of the cheapest goods that a bidder is shown before it gets a new list: at least so many, or this part of them; those it keeps.
SHOWN, PART, KEPT = 512, 64, 16
#: Bidders that bid one after another.
FEW = 12
#: Rows and columns of a tile of costs.
TILE = (128, 1_024)
#: Every how many columns are looked at for a threshold, and the least number of columns for which that is worth it.
SAMPLED, MANY = 8, 2_048


def _reduced(d: np.ndarray, hub: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if hub == "csls":
        return 2 * d - x - y
    if hub == "local_scaling":
        return 1 - np.exp(-d * d / np.maximum(x * y, 1e-300))
    below = lambda s: 1 / (1 + np.exp(np.clip(-1.702 * (d - s[..., 0]) / np.maximum(s[..., 1], 1e-300), -700, 700)))
    return 1 - (1 - below(x)) * (1 - below(y))


def reduced(d: np.ndarray, hub: str, scale_x: np.ndarray | None, scale_y: np.ndarray | None) -> np.ndarray:
    """Distances reduced for hubs by both sides' scales: a mean distance a row, or mean and deviation (mutual proximity)."""
    return d if hub == "none" else _reduced(d, hub, scale_x[:, None], scale_y[None])


def _scale_of(t: pa.Table, hub: str) -> np.ndarray:
    s = np.stack(t.column("s").to_numpy())
    return s if hub == "mutual_proximity" else s[:, 0]


class Goods:
    """Vectors of one side, asked for those of least cost plus price.

    Single precision chooses the candidates; their costs are taken in double precision, and the bound allows for the rounding.
    """

    def __init__(self, y: np.ndarray, scale: np.ndarray, metric: str, hub: str):
        self.y, self.scale, self.metric, self.hub = y, scale, metric, hub
        self.single = hub in ("none", "csls") and bool(np.isfinite(y).all())
        if self.single:
            self.middle = np.zeros(y.shape[1]) if metric == "cosine" else y.mean(0)
            turned = self._placed(y).T
            self.square = (turned.astype(float) ** 2).sum(0).astype(np.float32)
            ends = [np.ones(len(y), np.float32)] if metric == "cosine" else [self.square, np.ones(len(y), np.float32)]
            self.turned = np.ascontiguousarray(np.vstack([turned, *ends]))  # one product gives the whole distance
            self.sample = np.ascontiguousarray(self.turned[:, ::SAMPLED])

    def _placed(self, v: np.ndarray) -> np.ndarray:
        return (v / np.linalg.norm(v, axis=1)[:, None] if self.metric == "cosine" else v - self.middle).astype(np.float32)

    def _asked(self, x: np.ndarray, sx: np.ndarray) -> tuple:
        """What `_rough` needs of some rows, and how far off their costs in single precision may be, given the least distance."""
        if not self.single:
            return (x, sx), lambda least: np.zeros(len(x))
        v, one = self._placed(x), np.ones((len(x), 1), np.float32)
        unit = 8 * (v.shape[1] + 8) * float(np.finfo(np.float32).eps)
        own = (v.astype(float) ** 2).sum(1)
        wrong = unit * (own + float(self.square.max(initial=0)))  # of the square

        def off(least: np.ndarray) -> np.ndarray:
            o = np.full(len(x), unit) if self.metric == "cosine" else wrong / np.maximum(least, np.sqrt(wrong) + 1e-30)
            return 2 * o + unit * (np.abs(sx) + np.abs(self.scale).max(initial=0)) if self.hub == "csls" else o

        return (np.hstack([-v, one] if self.metric == "cosine" else [-2 * v, one, own[:, None].astype(np.float32)]), sx.astype(np.float32)), off

    def _rough(self, asked: tuple, which: slice, least: np.ndarray | None = None) -> np.ndarray:
        """Costs of the goods `which`, in single precision where the kind of reduction allows; `least` is lowered to their distances."""
        if not self.single:
            return reduced(distances(asked[0], self.y[which], self.metric), self.hub, asked[1], self.scale[which])
        d = asked[0] @ (self.sample if which.step else self.turned[:, which])
        if self.metric != "cosine":
            np.maximum(d, 0, out=d)
            np.sqrt(d, out=d)
            if least is not None:
                np.minimum(least, d.min(1), out=least)
        if self.hub == "csls":
            d *= np.float32(2)
            d -= self.scale[which].astype(np.float32)
            d -= asked[1][:, None]
        return d

    def costs(self, x: np.ndarray, sx: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The cost of cols[n] for each row n of x."""
        d = np.concatenate([exact(x[s : s + MANY], self.y[cols[s : s + MANY]], self.metric) for s in range(0, len(cols), MANY)] or [np.empty(0)])
        return d if self.hub == "none" else _reduced(d, self.hub, sx, self.scale[cols])

    def cheapest(self, x: np.ndarray, sx: np.ndarray, k: int, price: np.ndarray | None = None, shut: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, costs) of k goods of least cost plus price for each row, cost inf where there are fewer, and a bound below which no other lies.

        shut: columns that a row cannot have, or None.
        """
        n, m = len(x), len(self.y)
        cols, costs, bound = np.zeros((n, k), np.int32), np.full((n, k), np.inf), np.full(n, np.inf)
        added = None if price is None else price.astype(np.float32 if self.single else float)
        sampled = m >= MANY and 4 * k <= m
        for s in range(0, n, step := TILE[0] if sampled else max(1, TILE[0] * TILE[1] // max(1, m))):
            some, ss = x[s : s + step], sx[s : s + step]
            asked, off = self._asked(some, ss)
            least = np.full(len(some), np.inf)

            def net(which: slice, rows: np.ndarray | None = None) -> np.ndarray:
                d = self._rough(asked, which, least) if rows is None else self._rough(tuple(z[rows] for z in asked), which)  # noqa: B023
                if added is not None:
                    d += added[which]
                for r, n_ in enumerate((range(len(d)) if rows is None else rows.tolist()) if shut is not None else ()):
                    those = shut[s + n_]  # noqa: B023
                    if those is not None and len(those):
                        those = np.asarray(those)
                        here = those[(those >= (which.start or 0)) & (those < (m if which.stop is None else which.stop)) & ((those - (which.start or 0)) % (which.step or 1) == 0)]
                        d[r, (here - (which.start or 0)) // (which.step or 1)] = np.inf
                return d

            if sampled:
                want = k / SAMPLED
                limit = np.partition(net(slice(None, None, SAMPLED)), at := int(want + 4 * want**0.5) + 2, axis=1)[:, at]
                found = []
                wide = max(TILE[1], TILE[0] * TILE[1] // len(some))
                for t in range(0, m, wide):  # tiles that stay in the cache
                    d = net(slice(t, min(m, t + wide)))
                    r, c = np.divmod(np.flatnonzero((d <= limit[:, None]).ravel()), d.shape[1])
                    found.append((r, c + t, d[r, c]))
                r, c, near = (np.concatenate(z) for z in zip(*found, strict=True))
                few = np.flatnonzero(np.bincount(r, minlength=len(some)) <= k)
            else:
                limit, few = np.full(len(some), np.inf), np.arange(len(some))
                r, c, near = np.empty(0, int), np.empty(0, int), np.empty(0)
            if len(few):
                whole = net(slice(0, m), few)
                least[few] = 0 if not sampled else least[few]
                limit[few] = np.partition(whole, k, axis=1)[:, k] if m > k else np.inf
                keep = ~np.isin(r, few)
                at, col = np.nonzero(whole <= limit[few, None])
                r, c, near = np.concatenate([r[keep], few[at]]), np.concatenate([c[keep], col]), np.concatenate([near[keep], whole[at, col]])
            if not np.isfinite(near).all():
                r, c = r[np.isfinite(near)], c[np.isfinite(near)]
            cost = self.costs(some[r], ss[r], c)
            total = cost if price is None else cost + price[c]
            order = np.lexsort((c, total, r))
            r, c, cost, total = r[order], c[order], cost[order], total[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            own, next_ = place < k, place == k
            cols[s + r[own], place[own]], costs[s + r[own], place[own]] = c[own], cost[own]
            wrong = off(least) + (1e-6 * np.abs(price).max(initial=0) if price is not None and self.single else 0)
            bound[s : s + step] = limit.astype(float) - wrong
            bound[s + r[next_]] = np.minimum(bound[s + r[next_]], total[next_])
        return cols, costs, bound


def sold(cols: np.ndarray, costs: np.ndarray, bound: np.ndarray, first: np.ndarray, epsilons: list[float], fetch: Callable, look: Callable | None = None) -> np.ndarray:
    """The unit that each bidder holds at the end (-1: none was open to it).

    cols, costs and bound are the bidders' lists of goods at the price 0 ; good g has the units first[g] up to
    first[g + 1]. fetch(bidders, prices, k) gives new lists of k goods. With several epsilons there are as many units as
    bidders, so that all are taken at the end of each.

    At the end of an epsilon few goods are far cheaper than all others, and would call every list in question: look(bidders,
    goods) gives their costs, so that what is neither listed nor among them is known to have the least price of the rest.
    """
    n, goods, units = len(cols), len(first) - 1, int(first[-1])
    kind, size = np.repeat(np.arange(goods), np.diff(first)), np.diff(first)
    each, owner, held, paid = np.zeros(units), np.full(units, -1), np.full(n, -1), np.zeros(n)
    price = each if goods == units else np.zeros(goods)  # a good costs what its cheapest unit costs
    lost = np.zeros(n, bool)  # nothing is open to them
    base, sure = bound.astype(float), np.full(n, -np.inf)  # bounds at the price 0, and at the prices of some moment
    shown = max(SHOWN, goods // PART)
    listed = cols.shape[1]
    cols, costs = np.hstack([cols, np.zeros((n, KEPT), cols.dtype)]), np.hstack([costs, np.full((n, KEPT), np.inf, costs.dtype)])

    def edge(who: np.ndarray, lowest: float) -> np.ndarray:
        return np.maximum(base[who] + lowest, sure[who])  # what is not listed costs the lowest price more by now

    def renew(who: np.ndarray) -> None:
        if look is not None and goods > 4 * shown:
            cheap = np.argpartition(price, shown)
            rest, cheap = price[cheap[shown]], cheap[:shown]
            cost = look(who, cheap)
            net = cost + price[cheap]
            at = np.argpartition(net, KEPT, axis=1)[:, : KEPT + 1]
            near = np.take_along_axis(net, at, 1)
            at = np.take_along_axis(at, np.argsort(near, axis=1), 1)
            old = base[who] > -np.inf
            some, at = who[old], at[old]
            cols[some, listed:], costs[some, listed:] = cheap[at[:, :KEPT]], np.take_along_axis(cost[old], at[:, :KEPT], 1)
            sure[some] = np.minimum(base[some] + rest, near[old].max(1))
            short = np.ones(len(who), bool)
            short[old] = (costs[some] + price[cols[some]]).min(1) > sure[some]
            who = who[short]
        if len(who):
            cols[who], costs[who], sure[who] = fetch(who, price, cols.shape[1])
            base[who] = -np.inf
            lost[who] = ~np.isfinite(costs[who]).any(1)

    for step, epsilon in enumerate(epsilons):
        lowest = float(price.min(initial=np.inf))
        for s in range(0, n if step else 0, BIDS):  # who is not within the new epsilon of its best bids again
            who = s + np.flatnonzero(held[s : s + BIDS] >= 0)
            best = np.minimum((costs[who] + price[cols[who]]).min(1), edge(who, lowest))
            who = who[paid[who] + price[kind[held[who]]] > best + epsilon]
            owner[held[who]], held[who] = -1, -1
        waiting, asked, turn = np.flatnonzero((held < 0) & ~lost), [], 0
        while len(waiting) or asked:
            if not len(waiting) or sum(map(len, asked)) >= ASKED:
                who, asked = np.concatenate(asked), []
                renew(who)
                waiting = np.concatenate([waiting, who[~lost[who]]])
                continue
            if turn % 64 == 0:
                lowest = float(price.min())
            turn += 1
            if len(waiting) <= FEW and goods == units:
                stack = waiting.tolist()
                for _ in range(64 * FEW):  # one after another, without the cost of many at a time
                    if not stack:
                        break
                    i = stack.pop()
                    net = costs[i] + price[cols[i]]
                    at = int(net.argmin())
                    best, limit, good = net[at], max(base[i] + lowest, sure[i]), int(cols[i, at])
                    if not (best <= limit and best < np.inf):
                        asked.append(np.array([i]))
                        continue
                    net[cols[i] == good] = np.inf
                    second = min(net.min(), limit)
                    each[good] += (second - best if second < np.inf else 0.0) + epsilon
                    if owner[good] >= 0:
                        held[owner[good]] = -1
                        stack.append(int(owner[good]))
                    owner[good], held[i], paid[i] = i, good, costs[i, at]
                waiting = np.array(stack, np.int64)
                continue
            who, waiting = waiting[-BIDS:], waiting[:-BIDS]
            rows = np.arange(len(who))
            net = costs[who] + price[cols[who]]
            at = net.argmin(1)
            best, limit = net[rows, at], edge(who, lowest)
            open_ = (best <= limit) & np.isfinite(best)
            if not open_.all():
                asked.append(who[~open_])
                if not open_.any():
                    continue
            net[cols[who] == cols[who, at][:, None]] = np.inf
            second = np.minimum(net.min(1), limit)[open_]
            who, at, best = who[open_], at[open_], best[open_]
            good, cost = cols[who, at], costs[who, at]
            bid = price[good] + np.where(np.isfinite(second), second - best, 0.0) + epsilon
            order = np.lexsort((-bid, good))
            who, good, bid, cost = who[order], good[order], bid[order], cost[order]
            starts = np.flatnonzero(np.diff(good, prepend=-1))
            rank = np.arange(len(good)) - np.repeat(starts, np.diff(np.append(starts, len(good))))
            if goods == units:
                won, unit = rank == 0, good
            else:  # the highest bids get the cheapest units
                touched = good[starts]
                ends = np.cumsum(size[touched])
                all_ = np.arange(ends[-1]) - np.repeat(ends - size[touched], size[touched]) + np.repeat(first[touched], size[touched])
                all_ = all_[np.lexsort((each[all_], kind[all_]))]
                place = np.repeat(ends - size[touched], np.diff(np.append(starts, len(good)))) + np.minimum(rank, size[good] - 1)
                unit = all_[place]
                won = (rank < size[good]) & ((rank == 0) | (bid >= each[unit] + epsilon))
            gone = owner[unit[won]]
            gone = gone[gone >= 0]
            held[gone] = -1
            owner[unit[won]], held[who[won]], paid[who[won]], each[unit[won]] = who[won], unit[won], cost[won], bid[won]
            if goods != units:
                price[touched] = np.minimum.reduceat(each[all_], ends - size[touched])
            waiting = np.concatenate([waiting, who[~won], gone])
    return held


def steps(costs: np.ndarray, slack: float, even: bool, wide: float = 0.0) -> list[float]:
    """The epsilons of a pair: slack times the mean least cost; where all units are taken, after larger ones from a fourth of the spread on (`wide`: that of all costs)."""
    costs = costs[np.isfinite(costs).any(1)]
    if not len(costs):
        return [slack]
    least, most = costs.min(1), np.where(np.isfinite(costs), costs, -np.inf).max(1)
    m, w = np.abs(least).mean(), (most - least).mean()
    last = slack * (m if m > 0 else w if w > 0 else 1.0)  # where the least costs are all 0 the spread of the lists gives the unit
    w = max(w, wide)
    if not even or w <= 4 * last:
        return [last]
    n = int(np.ceil(np.log(w / 4 / last) / np.log(FALL)))
    return [last * (w / 4 / last) ** (i / n) for i in range(n, -1, -1)]


class Fetch:
    """New lists of a task's bidders from the vectors of all objects of the pair, at the prices of the moment."""

    def __init__(self, s: pa.Table, t: pa.Table, metric: str, hub: str):
        order = np.argsort(t.column("j").to_numpy())
        self.names, self.at = t.column("j").to_numpy()[order], {i: n for n, i in enumerate(s.column("i").to_pylist())}
        self.x, self.y = np.stack(s.column("v").to_numpy()), np.stack(t.column("v").to_numpy())[order]
        self.sx, self.sy, self.shut = _scale_of(s, hub), _scale_of(t, hub)[order], s.column("shut").to_pylist()
        self.metric, self.hub = metric, hub
        self.squares = [(v * v).sum(1) for v in (self.x, self.y)]

    def __call__(self, i: int, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Places of objects (in names), their costs and the bound of bidder i."""
        n = self.at[i]
        g, x, y = self.y @ self.x[n], self.squares[0][n], self.squares[1]
        d = 1 - g / (np.sqrt(x) * np.sqrt(y)) if self.metric == "cosine" else np.sqrt(np.maximum(0, x + y - 2 * g))
        cost = reduced(d[None], self.hub, self.sx[n : n + 1], self.sy)[0]
        if self.shut[n]:
            at = np.searchsorted(self.names, self.shut[n])
            cost[at[at < len(self.names)]] = np.inf
        net = cost + prices
        cols = np.argpartition(net, FETCHED)[: FETCHED + 1] if len(net) > FETCHED + 1 else np.arange(len(net))
        cols = cols[np.isfinite(net[cols])]
        cols = cols[np.argsort(net[cols], kind="stable")]
        whole = len(cols) <= FETCHED
        return (cols, cost[cols], np.inf) if whole else (cols[:-1], cost[cols[:-1]], float(net[cols[-1]]))


def bidding(lists: dict, price: dict, holder: dict, epsilon: float, fetch: Fetch | None = None, paid: dict | None = None) -> tuple[dict, set]:
    """New holders of objects as {object: (bidder, price)}, and the bidders that need a longer list and cannot fetch it.

    lists: bidder -> (objects, costs, bound, object held or None); price and holder hold what is known of the objects. paid is
    given the cost of each new holder's object.
    """
    each = [np.asarray(objects, np.int64) for objects, _, _, _ in lists.values()]
    if fetch is None:
        names, place = np.unique(np.concatenate([*each, np.empty(0, np.int64)]), return_inverse=True)
    else:
        names = fetch.names
        place = np.searchsorted(names, np.concatenate([*each, np.empty(0, np.int64)]))
    ends = np.cumsum([0, *map(len, each)])
    prices = np.array([price.get(j, 0.0) for j in names.tolist()])
    own = {i: (place[ends[n] : ends[n + 1]], np.asarray(costs, float), bound) for n, (i, (_, costs, bound, _)) in enumerate(lists.items())}
    holder = {n: holder[j] for n, j in enumerate(names.tolist()) if j in holder}
    waiting = [i for i, (_, _, _, held) in lists.items() if held is None]
    won, short, fetched = {}, set(), None
    while waiting:
        i = waiting.pop()
        objects, costs, bound = own[i]
        net = costs + prices[objects]
        at = int(net.argmin()) if len(net) else 0
        if not len(net) or net[at] > bound:
            if fetch is None or fetched == i:  # nothing is open to it
                short.add(i)
            else:
                own[i], fetched = fetch(i, prices), i
                waiting.append(i)
            continue
        best, j, fetched = net[at], int(objects[at]), None
        if paid is not None:
            paid[int(names[j])] = float(costs[at])
        net[at] = np.inf
        second = min(net.min(), bound)
        prices[j] += (second - best if np.isfinite(second) else 0.0) + epsilon
        before, holder[j], won[j] = holder.get(j), i, i
        if before is not None and before in own:
            waiting.append(before)
    return {int(names[j]): (i, float(prices[j])) for j, i in won.items()}, short


def _listed(t: pa.Table, own: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(goods, costs, bound) of the bidders `own` (sorted) from rows i, js, cs, bound, several a bidder; names: the goods' ids, sorted."""
    row = np.searchsorted(own, t.column("i").to_numpy())
    size, bound = pc.list_value_length(t.column("js")).to_numpy(), np.full(len(own), np.inf)
    np.minimum.at(bound, row, t.column("bound").to_numpy())
    order = np.argsort(row, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    start = np.empty(len(row), np.int64)
    start[order] = before - before[np.searchsorted(row[order], row[order])]  # what a bidder's rows before this one hold
    total = np.bincount(row, size, len(own)).astype(np.int64) if len(row) else np.zeros(len(own), np.int64)
    cols, costs = np.zeros((len(own), max(1, total.max(initial=0))), np.int32), np.full((len(own), max(1, total.max(initial=0))), np.inf, np.float32)
    rows, at = np.repeat(row, size), np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    cols[rows, at] = np.searchsorted(names, t.column("js").combine_chunks().flatten().to_numpy())
    costs[rows, at] = t.column("cs").combine_chunks().flatten().to_numpy()
    return cols, costs, bound


class Auction:
    """The pairs (a, b) of batches with the cells of each side, of which the smaller one bids.

    cells: cell_id, vec, batch; pairs: a, b. sizes tells the rows of every batch (a row a batch).
    """

    def __init__(self, cells: DataFrame, pairs: DataFrame, metric: str, slack: float, stored: Callable[[DataFrame], DataFrame], hub: str = "none", scales: DataFrame | None = None, region: int = REGION, listed: int = LISTED):
        self.metric, self.slack, self.stored, self.hub, self.region, self.listed = metric, slack, stored, hub, region, listed
        sizes = cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
        ways = pairs.join(sizes.select(F.col("batch").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("batch").alias("b"), F.col("n").alias("nb")), "b")
        ways = self.stored(ways.withColumn("flipped", F.col("na") > F.col("nb")))  # a row a pair of batches
        self.most = ways.agg(F.max(F.least("na", "nb")), F.max(F.greatest("na", "nb"))).first()
        self.ways = ways
        base = cells.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), "batch")
        side = lambda c: base.withColumnRenamed("batch", c).join(ways.select("a", "b", "flipped"), c)
        left, right = side("a"), side("b")
        pick = lambda l, r: l.filter("not flipped").unionByName(r.filter("flipped")).drop("flipped")  # noqa: E731, E741
        self.bidders, self.objects = pick(left, right), pick(right, left)
        if scales is not None:  # a, b, id, s: a cell's scales (an array) towards the other batch of the pair
            self.bidders, self.objects = (x.join(scales, ["a", "b", "id"]) for x in (self.bidders, self.objects))
        else:
            self.bidders, self.objects = (x.withColumn("s", F.array(F.lit(1.0))) for x in (self.bidders, self.objects))
        self.objects = self.objects.select(*[F.col(c).alias(c) for c in self.objects.columns])  # columns of its own
        self.kind = cells.schema["batch"].dataType.simpleString()

    def lists(self, bidders: DataFrame, prices: DataFrame, closed: DataFrame, listed: int, most: int, goods: DataFrame | None = None) -> DataFrame:
        """a, b, i, js, cs, bound: each bidder's `listed` objects of least cost plus price, without closed pairs (a, b, i, j).

        `most` bidders of a pair at the most; objects are in blocks of about LARGE rows, so that few lists have to be merged. With
        `goods` (a, b, id, v, s) these are listed, at the price 0, and the lists of the blocks are left as they are: about
        `listed` together, each with the bound of its block.
        """
        k, metric, hub = listed + 1, self.metric, self.hub
        nb = max(1, -(-int(self.most[1] or 0) // LARGE))
        na = max(1, min(-(-int(most) // BLOCK), max(2 * GRID // nb, -(-int(most) // LARGE))))
        merged = goods is None
        kept = k if merged else max(1, min(listed, int(listed / nb + 3 * (listed / nb) ** 0.5) + 2))
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        shut = closed.groupBy("a", "b", F.col("i").alias("id")).agg(F.collect_list("j").alias("shut"))  # a few rounds' partners
        x = bidders.join(shut, ["a", "b", "id"], "left").withColumn("p", dealt(na)).withColumn("q", every(nb))
        if goods is None:
            y = self.objects.join(prices.select("a", "b", F.col("j").alias("id"), "price"), ["a", "b", "id"], "left").fillna(0.0, ["price"])
        else:
            y = goods.select("a", "b", "id", "v", "s", F.lit(0.0).alias("price"))
        y = y.withColumn("q", dealt(nb)).withColumn("p", every(na))

        def run(s: pa.Table, t: pa.Table) -> pa.Table:
            n, j, c, net, bounds = [np.empty(0)] * 5
            if s.num_rows and t.num_rows:
                vx, vy = (np.stack(z.column("v").to_numpy()) for z in (s, t))
                jds, price = t.column("id").to_numpy(), t.column("price").to_numpy()
                those = s.column("shut").to_pylist()
                at = {j: n for n, j in enumerate(jds.tolist())} if any(those) else {}
                shut_ = [[at[j] for j in x or () if j in at] for x in those] if at else None
                cols, c, bounds = Goods(vy, _scale_of(t, hub), metric, hub).cheapest(vx, _scale_of(s, hub), kept, price if price.any() else None, shut_)
                open_ = np.isfinite(c)
                n, j, c, net = open_.sum(1), jds[cols[open_]], c[open_], (c + price[cols])[open_]
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            keys = s if s.num_rows else t
            same = lambda name: pa.array([keys.column(name)[0].as_py()] * len(n), keys.schema.field(name).type)
            columns = (("net", net, pa.float64()), ("js", j, pa.int64()), ("cs", c, pa.float64())) if merged else (("js", j, pa.int64()), ("cs", c, pa.float32()))
            lists = {c: pa.ListArray.from_arrays(ends, pa.array(z, kind)) for c, z, kind in columns}
            return pa.table({"a": same("a"), "b": same("b"), "i": s.column("id").combine_chunks().cast(pa.int64()) if len(n) else pa.array([], pa.int64()), **lists, "bound": pa.array(bounds, pa.float64())})

        keys = ["a", "b", "p", "q"]
        columns = "net array<double>, js array<long>, cs array<double>" if goods is None else "js array<long>, cs array<float>"
        found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(run, f"a {self.kind}, b {self.kind}, i long, {columns}, bound double")
        if goods is not None:
            return found
        every_ = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("net", "js", "cs"))))  # a list a block of objects
        best = found.groupBy("a", "b", "i").agg(every_.alias("l"), F.min("bound").alias("least"))
        bound = F.when(F.size("l") >= k, F.least("least", F.get("l", F.lit(k - 1))["net"])).otherwise(F.col("least"))
        out = best.select("a", "b", "i", F.slice("l", 1, k - 1).alias("l"), bound.alias("bound"))
        return out.select("a", "b", "i", F.col("l.js").alias("js"), F.col("l.cs").alias("cs"), "bound")

    def whole(self, closed: DataFrame, alike: bool) -> DataFrame:
        """a, b, i, j, d as solve gives it, each pair of batches being one region; alike: objects of equal vectors are one good."""
        metric, hub, slack = self.metric, self.hub, self.slack
        keys = ["a", "b"]
        if alike:
            goods = self.objects.groupBy("a", "b", "v", "s").agg(F.sort_array(F.collect_list("id")).alias("units"))
            goods = self.stored(goods.select("a", "b", F.col("units")[0].alias("id"), "v", "s", "units"))
        else:
            goods = self.objects.select("a", "b", "id", "v", "s", F.array("id").alias("units"))
        lists = self.lists(self.bidders, None, closed, min(self.listed, SHORT), self.most[0] or 0, goods)
        shut = closed.groupBy("a", "b", F.col("i").alias("id")).agg(F.collect_list("j").alias("units"))  # a few rounds' partners
        people = self.bidders.select("a", "b", "id", "v", "s").join(shut, ["a", "b", "id"], "left").withColumn("bids", F.lit(True))
        every = goods.withColumn("bids", F.lit(False)).unionByName(people)
        every = every.select(*[F.col(c).alias(c) for c in every.columns])  # columns of its own

        def run(s: pa.Table, t: pa.Table) -> pa.Table:
            ids, jds, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            bids = t.column("bids").to_numpy()
            if bids.any() and not bids.all():
                y, x = (t.filter(pa.array(bids == side)).sort_by("id") for side in (False, True))
                own, names = x.column("id").to_numpy(), y.column("id").to_numpy()
                vx, sx = np.stack(x.column("v").to_numpy()), _scale_of(x, hub)
                stock = Goods(np.stack(y.column("v").to_numpy()), _scale_of(y, hub), metric, hub)
                shut = None
                if x.column("units").null_count < len(x):  # only where every good is one object
                    shut = [np.searchsorted(names, those) if those else None for those in x.column("units").to_pylist()]
                    shut = [None if at is None else at[names[np.minimum(at, len(names) - 1)] == those] for at, those in zip(shut, x.column("units").to_pylist(), strict=True)]
                cols, costs, bound = _listed(s, own, names)
                fetch = lambda who, price, k: stock.cheapest(vx[who], sx[who], k, price, None if shut is None else [shut[n] for n in who])
                look = lambda who, goods: reduced(distances(vx[who], stock.y[goods], metric), hub, sx[who], stock.scale[goods])
                units = y.column("units").combine_chunks()
                first = np.concatenate([[0], np.cumsum(pc.list_value_length(units).to_numpy())])
                few = look(np.arange(0, len(own), -(-len(own) // 16)), slice(None))
                wide = float((few.mean(1) - few.min(1)).mean())
                held = sold(cols, costs, bound, first, steps(costs, slack, len(own) == first[-1], wide), fetch, look if shut is None else None)
                ids, jds = own[held >= 0], units.flatten().to_numpy()[held[held >= 0]]
                d = stock.costs(vx[held >= 0], sx[held >= 0], np.repeat(np.arange(len(names)), np.diff(first))[held[held >= 0]])
            same = lambda name: pa.array([t.column(name)[0].as_py()] * len(ids), t.schema.field(name).type)
            return pa.table({"a": same("a"), "b": same("b"), "i": pa.array(ids, pa.int64()), "j": pa.array(jds, pa.int64()), "d": pa.array(d, pa.float64())})

        found = lists.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(run, f"a {self.kind}, b {self.kind}, i long, j long, d double")
        return self._turned(found.select("a", "b", F.col("i").alias("bidder"), "j", "d"))

    def _turned(self, found: DataFrame) -> DataFrame:
        """a, b, i, j, d from a, b, bidder, j, d: i is of batch a and j of batch b."""
        out = found.join(F.broadcast(self.ways.select("a", "b", "flipped")), ["a", "b"])  # a row a pair of batches
        return out.select("a", "b", F.when(F.col("flipped"), F.col("j")).otherwise(F.col("bidder")).alias("i"), F.when(F.col("flipped"), F.col("bidder")).otherwise(F.col("j")).alias("j"), "d")

    def regions(self) -> DataFrame:
        """a, b, i, regions: the region of each bidder, for each way to draw them; none holds much more than `region` bidders."""
        n = int(self.most[0] or 0)
        many = min(MAX_PIVOTS, -(-n // self.region))
        if many <= 1:
            return self.bidders.select("a", "b", F.col("id").alias("i"), F.array(*[F.lit(0)] * TURNS).alias("regions"))
        # At most MAX_PIVOTS * TURNS vectors for all pairs.
        drawn = self.bidders.select("id", "v").distinct().orderBy(F.xxhash64("id", F.lit(3)), "id").limit(many * TURNS).collect()
        pivots = np.stack([r["v"] for r in drawn])
        metric = self.metric

        def run(batches):
            for b in batches:
                d = distances(np.stack(b.column("v").to_numpy(zero_copy_only=False)), pivots, metric) if b.num_rows else np.empty((0, len(pivots)))
                near = [np.argmin(d[:, t::TURNS], axis=1) if b.num_rows else np.empty(0, int) for t in range(TURNS)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("id"), pa.array(np.stack(near, 1).tolist(), pa.list_(pa.int32()))], names=["a", "b", "i", "regions"])

        near = self.stored(self.bidders.select("a", "b", "id", "v").mapInArrow(run, f"a {self.kind}, b {self.kind}, i long, regions array<int>"))
        parts = []
        for t in range(TURNS):  # crowded regions are split by a hash
            size = near.groupBy("a", "b", F.col("regions")[t].alias("g")).agg(F.count(F.lit(1)).alias("n"))
            cut = size.select("a", "b", "g", F.ceil(F.col("n") / (2 * self.region)).cast("int").alias("cut"))
            each = near.select("a", "b", "i", F.col("regions")[t].alias("g")).join(cut, ["a", "b", "g"])
            parts.append(each.select("a", "b", "i", F.lit(t).alias("t"), (F.col("g") * 1_000_000 + F.pmod(F.xxhash64("i", F.lit(t)), F.col("cut"))).cast("int").alias("g")))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        return whole.groupBy("a", "b", "i").agg(F.sort_array(F.collect_list(F.struct("t", "g"))).alias("l")).select("a", "b", "i", F.col("l.g").alias("regions"))

    def bids(self, lists: DataFrame, people: DataFrame, prices: DataFrame, epsilon: DataFrame, turn: int, closed: DataFrame) -> DataFrame:
        """a, b, i, j, price, cost: what the regions with a bidder without object bid; j null where a longer list is needed.

        people: a, b, i, regions of all bidders; a region's task gets its lists and the prices of its pair of batches.
        """
        region = F.col("regions")[turn % TURNS]
        held = prices.filter("holder is not null").select("a", "b", F.col("holder").alias("i"))
        busy = people.join(held, ["a", "b", "i"], "left_anti").select("a", "b", region.alias("g")).distinct()
        busy = self.stored(busy.join(epsilon, ["a", "b"]))  # a row a region
        if busy.isEmpty():
            return None
        asked = lists.join(people.select("a", "b", "i", region.alias("g")), ["a", "b", "i"]).join(F.broadcast(busy), ["a", "b", "g"])
        near, metric, hub = int(self.most[1] or 0) <= NEAR, self.metric, self.hub
        known = prices
        if near:
            shut = closed.groupBy("a", "b", "i").agg(F.collect_list("j").alias("shut"))  # a few rounds' partners
            asked = asked.join(self.bidders.select("a", "b", F.col("id").alias("i"), "v", "s"), ["a", "b", "i"]).join(shut, ["a", "b", "i"], "left")
            known = self.objects.select("a", "b", F.col("id").alias("j"), "v", "s").join(prices, ["a", "b", "j"], "left").fillna(0.0, ["price"])
        known = known.join(F.broadcast(busy.select("a", "b", "g")), ["a", "b"])
        known = known.select(*[F.col(c).alias(c) for c in ("a", "b", "g", "j", "price", "holder", *(("v", "s") if near else ()))])  # columns of its own

        def run(s: pa.Table, t: pa.Table) -> pa.Table:
            out = []
            if s.num_rows:
                js, cs = (s.column(c).combine_chunks().flatten().to_numpy() for c in ("js", "cs"))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(s.column("js")).to_numpy())])
                objects, price, holders = (t.column(c).to_pylist() for c in ("j", "price", "holder"))
                holder = {j: i for j, i in zip(objects, holders, strict=True) if i is not None}
                held = {i: j for j, i in holder.items()}
                ids, bound = s.column("i").to_pylist(), s.column("bound").to_pylist()
                lists = {i: (js[ends[n] : ends[n + 1]], cs[ends[n] : ends[n + 1]], bound[n], held.get(i)) for n, i in enumerate(ids)}
                fetch, paid = Fetch(s, t, metric, hub) if near and t.num_rows else None, {}
                won, short = bidding(lists, dict(zip(objects, price, strict=True)), holder, s.column("epsilon")[0].as_py(), fetch, paid)
                if short and len(js) and fetch is None:  # who has few objects below the bound is asked along, as another round would ask for it
                    names, place = np.unique(js, return_inverse=True)
                    now = dict(zip(objects, price, strict=True)) | {j: p for j, (_, p) in won.items()}
                    below = cs + np.array([now.get(j, 0.0) for j in names.tolist()])[place] <= np.repeat(bound, np.diff(ends))
                    left = np.diff(np.concatenate([[0], np.cumsum(below)])[ends])
                    short |= {ids[n] for n in np.nonzero(4 * left < np.diff(ends))[0].tolist()}
                out = [(i, j, p, paid[j]) for j, (i, p) in won.items()] + [(i, None, None, None) for i in short]
            keys = s if s.num_rows else t
            same = lambda name: pa.array([keys.column(name)[0].as_py()] * len(out), keys.schema.field(name).type)
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.table({"a": same("a"), "b": same("b"), **{c: pa.array(x, k) for c, x, k in zip(("i", "j", "price", "cost"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)}})

        keys = ["a", "b", "g"]
        return self.stored(asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(run, f"a {self.kind}, b {self.kind}, i long, j long, price double, cost double"))

    def solve(self, closed: DataFrame, alike: bool = False) -> DataFrame:
        """a, b, i, j, d: a partner for each bidder, i of batch a and j of batch b, d the cost; alike: no pair is closed."""
        if int(self.most[1] or 0) <= NEAR and self.region >= min(REGION, int(self.most[0] or 0)):
            return self.whole(closed, alike)
        none = self.stored(closed.limit(0).select("a", "b", "j", F.lit(0.0).alias("price"), F.col("i").alias("holder"), F.lit(0.0).alias("cost")))
        first = self.stored(self.lists(self.bidders, none, closed, self.listed, self.most[0] or 0))
        people, longer, lists = self.stored(self.regions()), None, first
        epsilon = first.groupBy("a", "b").agg(F.avg(F.abs(F.array_min("cs"))).alias("m"), F.avg(F.array_max("cs") - F.array_min("cs")).alias("w"))
        # Where the least costs are all 0 the spread of the lists gives the unit.
        last = self.slack * F.when(F.col("m") > 0, F.col("m")).when(F.col("w") > 0, F.col("w")).otherwise(1.0)
        epsilon = epsilon.join(self.ways.select("a", "b", (F.col("na") == F.col("nb")).alias("even")), ["a", "b"]).withColumn("last", last)
        steps = F.when(F.col("even") & (F.col("w") > 4 * F.col("last")), F.ceil(F.log(F.col("w") / 4 / F.col("last")) / float(np.log(FALL)))).otherwise(0)
        epsilon = self.stored(epsilon.select("a", "b", "even", "last", steps.cast("int").alias("steps")))
        prices, turn = none, 0
        for step in range(int(epsilon.agg(F.max("steps")).first()[0] or 0), -1, -1):
            now = epsilon.select("a", "b", (F.col("last") * F.pow(F.lit(FALL), F.least(F.lit(step), "steps"))).alias("epsilon"))
            free = epsilon.filter(F.col("steps") > step).select("a", "b", F.lit(True).alias("free"))  # pairs whose epsilon falls
            prices = self.stored(prices.join(F.broadcast(free), ["a", "b"], "left").select("a", "b", "j", "price", F.when(F.col("free").isNull(), F.col("holder")).alias("holder"), "cost"))
            while True:
                new = self.bids(lists, people, prices, now, turn, closed)
                if new is None:
                    break
                turn += 1
                every = prices.union(new.filter("j is not null").select("a", "b", "j", "price", F.col("i").alias("holder"), "cost"))
                top = every.groupBy("a", "b", "j").agg(F.max(F.struct("price", (-F.col("holder")).alias("h"), "cost")).alias("s"))
                prices = self.stored(top.select("a", "b", "j", "s.price", (-F.col("s.h")).alias("holder"), "s.cost"))
                short = new.filter("j is null").select("a", "b", "i")
                if n := short.count():
                    again = self.bidders.join(F.broadcast(short.withColumnRenamed("i", "id")), ["a", "b", "id"], "left_semi")
                    # The fewer they are, the longer their lists: all of them together hold about MORE objects.
                    fresh = self.lists(again, prices, closed, max(self.listed, min(int(self.most[1]), MORE // n)), n)
                    if longer is not None:
                        fresh = longer.join(F.broadcast(short), ["a", "b", "i"], "left_anti").unionByName(fresh)
                    longer = self.stored(fresh)
                    lists = first.join(longer.select("a", "b", "i"), ["a", "b", "i"], "left_anti").unionByName(longer)
        return self._turned(prices.filter("holder is not null").select("a", "b", F.col("holder").alias("bidder"), "j", F.col("cost").alias("d")))

    def rounds(self, n: int) -> DataFrame:
        """a, b, i, j, d, round: matches of n rounds; pairs of a round are closed for later ones."""
        out = None
        closed = self.bidders.limit(0).select("a", "b", F.col("id").alias("i"), F.col("id").alias("j"))
        for r in range(n):
            now = self.stored(self.solve(closed, r == 0).withColumn("round", F.lit(r)))
            out = now if out is None else out.union(now)
            turned = out.join(F.broadcast(self.ways.select("a", "b", "flipped")), ["a", "b"])  # a row a pair of batches
            closed = turned.select("a", "b", F.when(F.col("flipped"), F.col("j")).otherwise(F.col("i")).alias("i"), F.when(F.col("flipped"), F.col("i")).otherwise(F.col("j")).alias("j"))
        return out
