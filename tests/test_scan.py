"""The whole scan: its fixed point against a loop over dates, its stage flags, and that no date reads later rows."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelwright.plans import pointintime as pt
from panelwright.plans import scan as S
from panelwright.sources.panels import Panels

from .conftest import SF

BASE = "symbol long, date date, mode string, industry string, composite_score double, floor double, keep int, capped boolean, overlaps boolean"


def loop(rows):
    """One date after the other, a mode's last list in hand."""
    out, last = {}, {}
    for date, mode in sorted({(r[1], r[2]) for r in rows}):
        scored = []
        for symbol, _, _, industry, score, floor, keep, capped, overlaps in (r for r in rows if r[1:3] == (date, mode)):
            s = round(score * (1 + (S.OVERLAP if overlaps and symbol in last.get(mode, ()) else 0)), 9)
            if floor is None or s >= floor:
                scored.append((-s, symbol, industry, keep, capped))
        per, kept = {}, []
        for _, symbol, industry, keep, capped in sorted(scored)[: 2 * S.TOP]:
            per[industry] = per.get(industry, 0) + 1
            if (not capped or per[industry] <= S.rk.sector_cap(S.TOP)) and len(kept) < keep:
                kept.append(symbol)
        out[date, mode] = kept
        last[mode] = kept or last.get(mode, ())
    return {k: v for k, v in out.items() if v}


def test_fixed_point_equals_the_loop_over_dates(spark):
    """Ever closer scores, so that one changed list changes the next; one empty date in between."""
    from datetime import date, timedelta

    rng = random.Random(2)
    rows, dates = [], [date(2020, 1, 31) + timedelta(days=30 * k) for k in range(9)]
    for mode, capped, overlaps in (("momentum", True, True), ("swing", False, True), ("value", False, False)):
        for k, d in enumerate(dates):
            low = 0.9 if (mode, k) == ("swing", 4) else 0.5
            rows += [(n, d, mode, f"i{n % 7}", 0.6 + 0.0005 * ((n * 7 + k * 11) % 61) + rng.random() * 0.005, low, S.TOP if k % 3 else 6, capped, overlaps) for n in range(60)]
    picks, rounds = S.settled(Panels(spark, SF), spark.createDataFrame(rows, BASE))
    got = {}
    for r in picks.orderBy("rank").collect():
        got.setdefault((r.date, r["mode"]), []).append(r.symbol)
    assert got == loop(rows)
    assert 2 <= rounds <= len(dates)
    alone = loop([(*r[:8], False) for r in rows])
    assert sum({*v} != {*alone[k]} for k, v in got.items()) >= 5


def test_stages_can_be_left_out(spark):
    p = Panels(spark, SF)
    names = lambda **off: {(r.symbol, r.date, r["mode"]) for r in S.adjusted(p, {m: replace(s, **off) for m, s in S.STAGES.items()}).select("symbol", "date", "mode").collect()}
    every = names()
    for stage in ("universe", "coarse", "risk_filter"):
        more = names(**{stage: False})
        assert len(more) > len(every), stage


def test_no_scan_date_reads_later_rows(spark, tmp_path):
    """Rows after a date are cut from the tables; what the bonus stages see at that date stays the same."""
    whole = Panels(spark, SF)
    dates = sorted(r.date for r in whole.scan_dates().collect())
    last = dates[len(dates) * 2 // 3]
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        whole.table(t).write.parquet(f"{tmp_path}/{t}.parquet")
    whole.table("lineitem").where(F.col("l_shipdate") < F.date_add(F.lit(last), 7)).write.parquet(f"{tmp_path}/lineitem.parquet")
    short = Panels(spark, str(tmp_path))
    columns = ["symbol", "sector_bonus", "relative_strength_bonus", "key_player_cost"]

    def seen(p):
        flow, ret = pt.frame_sums(p), pt.returns(p)
        s = S.rk.sector_bonus(pt.sector_ranks(p, flow, ret), p.info(), by="date").select("symbol", "date", "sector_bonus")
        x = pt.fl.relative_strength_in(ret.select("symbol", "date", F.col("ret20").alias("ret")).where("ret is not null").join(p.info().select("symbol", "industry"), "symbol"), p.xs, ["date", "industry"])
        d = pt.names(p).join(s, ["symbol", "date"], "left").join(x.drop("industry", "ret"), ["symbol", "date"], "left").join(pt.key_players(p), ["symbol", "date"], "left")
        d = d.where(F.col("date") == F.lit(last)).select("symbol", *[F.round(c, 9) for c in columns[1:]])
        return sorted(map(tuple, d.collect()))

    got = seen(whole)
    assert got == seen(short) and len(got) > 5 and len({r[1] for r in got}) > 2


@pytest.mark.parametrize("n", [1, 20])
def test_frames_hold_the_last_market_dates(spark, n):
    p = Panels(spark, SF)
    weeks = sorted(r.date for r in pt.market(p).collect())
    got = {}
    for r in pt.seen_dates(p, n).collect():
        got.setdefault(r.scan, {})[r.age] = r.date
    for scan, ages in got.items():
        k = weeks.index(scan)
        assert [ages[a] for a in range(len(ages))] == weeks[max(0, k - n + 1) : k + 1][::-1]
