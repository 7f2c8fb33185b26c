"""Monthly Gold tables refreshed by load against full builds of the same rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from helpers import rows, small_silver, ts

from martflow.operators import gold
from martflow.plans.incremental import STORED, MonthlyGold

CENTRES = [dict(distribution_center_id=1, name="A"), dict(distribution_center_id=2, name="B")]


def item(i, order, at, product=1, delivered=None, price=10.0):
    return dict(order_item_id=i, order_id=order, user_id=1, product_id=product, status="Complete", created_at=at and ts(at),
                delivered_at=delivered and ts(delivered), sale_price=price, is_returned=False)


def event(i, user, session, at, kind="home"):
    return dict(event_id=i, user_id=user, session_id=session, created_at=at and ts(at), event_type=kind, is_anonymous=user is None)


PRODUCTS = [dict(product_id=1, distribution_center_id=1), dict(product_id=2, distribution_center_id=2)]
FIRST = dict(items=[item(1, 1, "2001-01-05", delivered="2001-01-08"), item(2, 1, "2001-01-05"), item(3, 2, "2001-02-01", 2),
                    item(4, 3, "2001-03-01"), item(5, 4, None)],
             events=[event(1, 1, "a", "2001-01-01"), event(2, 1, "b", "2001-03-01"), event(3, 1, "c", "2001-03-02"),
                     event(4, 2, "d", "2001-02-01"), event(5, None, "e", "2001-02-01"), event(6, 2, "f", None),
                     event(7, 2, "g", "2001-04-01")])


def files(root, name):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/{name}/*=*/*.parquet")}


def months_of(changed):
    return {f.split("month=")[1][:7] for f, _ in changed}


class Kept:
    """A store beside the plain list of current rows."""

    def __init__(self, spark, root):
        self.spark, self.store, self.load = spark, MonthlyGold(spark, str(root)), 0
        self.now = {"lines": {}, "events": {}}
        self.products = PRODUCTS

    def bring(self, items=(), events=(), withdrawn=()):
        s = small_silver(self.spark, items=items, events=events, dcs=CENTRES)
        for name, new in (("lines", items), ("events", events)):
            silver_name, key = STORED[name]
            if new:
                df = s[silver_name].withColumn("withdrawn", F.col(key).isin(list(withdrawn)))
                self.store.append(name, df, self.load)
            for r in new:
                self.now[name].pop(r[key], None)
                if r[key] not in withdrawn:
                    self.now[name][r[key]] = r
        self.load += 1
        silver = self.silver()
        return self.store.refresh(silver["products_clean"], silver["distribution_centers_clean"])

    def silver(self):
        return small_silver(self.spark, items=list(self.now["lines"].values()), events=list(self.now["events"].values()),
                            products=self.products, dcs=CENTRES)

    def check(self):
        want = gold.gold_layer(self.silver(), self.store.cfg)
        for name in ("fulfillment_metrics", "funnel_analytics"):
            got = self.store.table(name)
            assert got.columns == want[name].columns and got.dtypes == want[name].dtypes
            assert sorted(map(repr, rows(_text(got)))) == sorted(map(repr, rows(_text(want[name]))))


def _text(df):
    return df.selectExpr(*[f"cast({c} as string) {c}" for c in df.columns]).na.fill("null")


def test_refreshes_equal_full_builds(spark, tmp_path, monkeypatch):
    root, kept = tmp_path / "gold", Kept(spark, tmp_path / "gold")
    kept.bring(**FIRST)
    kept.check()

    # a late file changes only its months
    before = {n: files(root, n) for n in ("fulfillment_metrics", "funnel_analytics")}
    done = kept.bring(items=[item(6, 9, "2001-02-07", delivered="2001-02-09")], events=[event(8, 3, "h", "2001-02-03")])
    kept.check()
    assert done == {"fulfillment_metrics": [ts("2001-02-01")], "funnel_analytics": [ts("2001-02-01")], "sessions_change": []}
    for name, old in before.items():
        assert months_of(set(old.items()) ^ set(files(root, name).items())) == {"2001-02"}

    # nothing new rewrites nothing
    before = files(root, "f*s")
    assert kept.bring() == {"fulfillment_metrics": [], "funnel_analytics": [], "sessions_change": []}
    assert files(root, "f*s") == before

    # user 1 has visits in January and March; those of February change what March is held against
    done = kept.bring(events=[event(10, 1, "h", "2001-02-03"), event(11, 1, "i", "2001-02-04")])
    kept.check()
    assert done["funnel_analytics"] == [ts("2001-02-01")] and done["sessions_change"] == [ts("2001-03-01")]

    # a product's move redoes the months of its lines
    kept.products = [PRODUCTS[0], dict(product_id=2, distribution_center_id=1)]
    assert kept.bring()["fulfillment_metrics"] == [ts("2001-02-01")]
    kept.check()

    # a refresh that is cut off before its end is run again
    real = MonthlyGold._replace

    def dies(self, name, *rest):
        real(self, name, *rest)
        if name == "funnel_analytics":
            raise RuntimeError("lost")
    monkeypatch.setattr(MonthlyGold, "_replace", dies)
    with pytest.raises(RuntimeError):
        kept.bring(items=[item(7, 7, "2001-03-05")], events=[event(1, 4, "a", "2001-01-01"), event(2, 5, "b", "2001-03-01")])
    monkeypatch.setattr(MonthlyGold, "_replace", real)
    kept.bring()
    kept.check()


def test_corrections_withdrawals_and_emptied_months(spark, tmp_path):
    kept = Kept(spark, tmp_path / "gold")
    kept.bring(**FIRST)
    kept.bring(items=[item(2, 1, "2001-01-05", delivered="2001-01-30"), item(3, 2, "2001-02-01", 2)],
               events=[event(3, None, "b", "2001-03-02", "cart"), event(4, 2, "d", "2001-02-01")], withdrawn=[3, 4])
    kept.check()                                             # February has no lines and no visits left
    assert not glob.glob(f"{tmp_path}/gold/fulfillment_metrics/order_month=2001-02*")
    assert not glob.glob(f"{tmp_path}/gold/funnel_analytics/event_month=2001-02*")
    kept.bring(items=[item(5, 4, None, 2)], events=[event(6, 2, "f2", None), event(9, 9, "z", None)])
    kept.check()                                             # rows without a time
