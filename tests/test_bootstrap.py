"""The bootstrap takes as many draws as the reference."""

from tidemark import catalog


def test_win_rates_are_shares_of_5000_draws(spark):
    rates = [r.win_rate for r in catalog.QUERIES["bootstrap_wins"](spark, "/root/testdata/sf0.001").collect()]
    assert abs(sum(rates) - 1) < 1e-9
    assert all(abs(r * 5000 - round(r * 5000)) < 1e-6 for r in rates)
    assert any(abs(r * 500 - round(r * 500)) > 1e-3 for r in rates)
