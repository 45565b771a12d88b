"""Stages that score forecasts stay small enough for the virtual machine to compile them; larger methods run interpreted."""

import re

import pytest

from foretally.catalog import derived
from foretally.contracts import SIDE_LINES, SIDE_MODELS, TOTAL_LINES
from foretally.operators import pairing, scoring
from foretally.plans import reports, sides, totals
from foretally.sources.contest_log import FIXTURE_START

FOLDER = "/root/testdata/sf0.001"
COMPILED = 8000  # bytes of code of a method that is still compiled

STEPS = {
    "side deltas": lambda d: pairing.fixture_deltas(pairing.side_deltas(pairing.panel_pair(d.side_panel, SIDE_MODELS, *SIDE_MODELS))),
    "side tally": lambda d: scoring.tally_counts(
        sides.long_forecasts(sides.side_panel(pairing.counted_contests(d.contests, FIXTURE_START), d.ledger, FIXTURE_START)),
        SIDE_LINES, ["competition", "model", "venue"], copies="copies",
    ),
    "decay panel": lambda d: d.decay_panel,
    "decay blocks": lambda d: pairing.block_totals(reports.decay_deltas(d.decay_panel), ["competition", "pair"]),
    "total tally": lambda d: scoring.tally_counts(
        totals.counted_total_forecasts(d.contests, d.ledger, FIXTURE_START), TOTAL_LINES, ["competition"], copies="copies"
    ),
}


@pytest.mark.parametrize("step", STEPS)
def test_stages_are_compiled(spark, capsys, step):
    frame = STEPS[step](derived(spark, FOLDER))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        frame.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < COMPILED
