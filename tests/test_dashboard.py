"""A refresh reads the item lines once, and every frame is what the report alone gives."""

from __future__ import annotations

import re

import pytest

from basketry.plans import dashboard, features, quality, reports, segments
from basketry.sources.files import load_tables, write_tables
from fixtures import shop


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def stored(spark, tmp_path):
    write_tables(quality.clean(shop(spark)), str(tmp_path / "db"))
    return load_tables(spark, str(tmp_path / "db"))


def test_frames_equal_the_reports(stored, tmp_path):
    got = dashboard.refresh(stored, str(tmp_path / "work"))
    want = {
        "features": segments.rfm_segment(features.customer_features(stored)),
        "timeline": reports.monthly_timeline(stored),
        "states": reports.by_state(stored),
        "review_scores": reports.review_scores(stored),
        "payments": reports.payment_types(stored),
        "sellers": reports.top_sellers(stored),
        "categories": reports.top_categories(stored),
        "kpis": reports.kpis(stored, features.rfm_base(stored)),
    }
    assert set(got) == set(want)
    for name, df in want.items():
        assert got[name].dtypes == df.dtypes, name
        assert rows(got[name]) == rows(df), name


def test_order_items_are_read_by_no_frame(stored, tmp_path):
    assert len(re.findall(r"/order_items\]", plan(dashboard.reduced_lines(stored)))) == 1
    frames = dashboard.refresh(stored, str(tmp_path / "work"))
    for name, df in frames.items():
        assert "/order_items]" not in plan(df), name
    assert any("/lines-" in plan(df) for df in frames.values())


def test_lines_are_made_again_for_a_new_load_only(spark, stored, tmp_path):
    work = tmp_path / "work"
    dashboard.refresh(stored, str(work))
    dashboard.refresh(stored, str(work))
    assert len(list(work.iterdir())) == 1
    write_tables({"order_items": stored["order_items"].limit(3)}, str(tmp_path / "db"))
    again = load_tables(spark, str(tmp_path / "db"))
    timeline = dashboard.refresh(again, str(work))["timeline"]
    assert len(list(work.iterdir())) == 2
    assert rows(timeline) == rows(reports.monthly_timeline(again))
