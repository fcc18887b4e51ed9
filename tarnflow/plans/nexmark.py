"""Auction queries over persons, auctions and bids, with times and prices as integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import windows as win
from tarnflow.operators.aggregates import extreme_element
from tarnflow.operators.stateful import commit_after, rich_map_custom

#: Columns of the inputs: person(id, name, city, state, date_time), auction(id, seller, category, reserve,
#: date_time, expires), bid(auction, bidder, price, date_time).


def q0(bids: DataFrame) -> DataFrame:
    return bids


def q1(bids: DataFrame) -> DataFrame:
    """Prices in another currency, in single precision, cut to an integer."""
    return bids.withColumn("price", (F.col("price").cast("float") * F.lit(0.908).cast("float")).cast("long"))


def q2(bids: DataFrame) -> DataFrame:
    return bids.where("auction % 123 = 0").select("auction", "price")


def q3(persons: DataFrame, auctions: DataFrame, category: int, states: list[str]) -> DataFrame:
    people = persons.where(F.col("state").isin(states)).select(F.col("id").alias("seller"), "name", "city", "state")
    return auctions.where(F.col("category") == category).select("id", "seller").join(people, "seller").select("name", "city", "state", "id")


def winning_bids(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Each auction's highest bid of at least the reserve within its time, the earliest of equal ones."""
    a = auctions.select("id", "seller", "category", "reserve", F.col("date_time").alias("opens"), "expires")
    valid = bids.join(a, F.col("auction") == F.col("id")).where("price >= reserve and date_time >= opens and date_time < expires")
    best = F.max_by(F.struct("seller", "category", "bidder", "price", "date_time", "expires"), F.struct("price", (-F.col("date_time")).alias("t"), (-F.col("bidder")).alias("b"))).alias("w")
    return valid.groupBy("auction").agg(best).select("auction", "w.*")


def q4(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    return winning_bids(auctions, bids).groupBy("category").agg(F.avg("price").alias("avg_price"))


def _merged(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Auctions and their bids as one flow of events, an auction before the bids of its time."""
    opened = auctions.select(F.col("id").alias("auction"), F.lit(0).alias("kind"), F.col("date_time").alias("ts"), "category", "reserve", "expires", F.lit(None).cast("long").alias("bidder"), F.lit(None).cast("long").alias("price"))
    none = F.lit(None).cast("long")
    made = bids.select("auction", F.lit(1).alias("kind"), F.col("date_time").alias("ts"), none.alias("category"), none.alias("reserve"), none.alias("expires"), "bidder", "price")
    return opened.unionByName(made)


def _better(bid: dict, best: dict | None) -> bool:
    return best is None or (-bid["price"], bid["ts"], bid["bidder"]) < (-best["price"], best["ts"], best["bidder"])


def q4_opt(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """q4 in one pass over the events of each auction, by a closure that keeps the auction and its best bid so far."""

    def make():
        auction: list[dict] = []
        best: list[dict | None] = [None]

        def step(row):
            if row is None:
                return [{"category": auction[0]["category"], "price": best[0]["price"]}] if best[0] else []
            if row["kind"] == 0:
                auction.append(row)
            elif auction and row["price"] >= auction[0]["reserve"] and auction[0]["ts"] <= row["ts"] < auction[0]["expires"] and _better(row, best[0]):
                best[0] = row
            return []

        return step

    won = rich_map_custom(_merged(auctions, bids), ["auction"], ["ts", "kind"], make, "category long, price long")
    return won.groupBy("category").agg(F.avg("price").alias("avg_price"))


def committed_bids(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Winning bids by transaction windows: an auction sets the time after which the window of its events commits."""

    def fold(rows: list[dict]) -> dict | None:
        auction = next((r for r in rows if r["kind"] == 0), None)
        best = None
        for r in rows:
            if auction and r["kind"] == 1 and r["price"] >= auction["reserve"] and auction["ts"] <= r["ts"] < auction["expires"] and _better(r, best):
                best = r
        return best and {"auction": best["auction"], "category": auction["category"], "bidder": best["bidder"], "price": best["price"]}

    return commit_after(_merged(auctions, bids), ["auction"], ["ts", "kind"], "ts", "expires", "auction long, category long, bidder long, price long", fold)


def q5(bids: DataFrame, size: int, slide: int) -> DataFrame:
    """The auction with most bids in each sliding window; of equal ones the least id.

    Bids are counted by slide first; only these counts are spread over the windows.
    """
    if size % slide:
        counts = win.aggregate(bids.withColumnRenamed("date_time", "ts"), ["auction"], win.EventTimeWindow(size, slide, align="epoch"), [], n="count(*)")
    else:
        step = F.floor(F.col("date_time") / slide).cast("long")
        parts = bids.groupBy("auction", step.alias("step")).agg(F.count(F.lit(1)).alias("part"))
        spread = parts.select("auction", "part", F.explode(F.sequence(F.col("step") - size // slide + 1, F.col("step"))).alias("k"))
        counts = spread.groupBy("auction", (F.col("k") * slide).alias("win")).agg(F.sum("part").alias("n"))
    return counts.groupBy("win").agg(F.max(F.struct("n", (-F.col("auction")).alias("a"))).alias("m")).select("win", (-F.col("m.a")).alias("auction"), F.col("m.n").alias("n"))


def q6(auctions: DataFrame, bids: DataFrame, last: int = 10) -> DataFrame:
    """Each seller's average over every ``last`` winning bids in a row, in order of the auctions' ends."""
    won = winning_bids(auctions, bids)
    return win.aggregate(won, ["seller"], win.CountWindow.sliding(last, 1), ["expires", "auction"], avg_price="avg(price)")


def q7(bids: DataFrame, size: int) -> DataFrame:
    """The highest bid of each tumbling window, the earliest of equal ones."""
    assigned = win.EventTimeWindow.tumbling(size, align="epoch").assign(bids.withColumnRenamed("date_time", "ts"), [], [])
    return extreme_element(assigned, ["win"], "price", ["ts", "auction", "bidder"], True).select("win", "auction", "bidder", "price")


def q8(persons: DataFrame, auctions: DataFrame, size: int) -> DataFrame:
    """People who opened auctions in the tumbling window in which they registered."""
    p = persons.select(F.col("id").alias("seller"), "name", F.col("date_time").alias("ts"))
    a = auctions.select("seller", F.col("id").alias("auction"), F.col("date_time").alias("ts"))
    out = win.window_join(p, a, ["seller"], win.EventTimeWindow.tumbling(size, align="epoch"))
    return out.select("seller", "name", "win", F.col("r_auction").alias("auction"))
