"""The driver's contract."""

import __spark_entry__ as entry


def test_optional_parts_can_be_missing(monkeypatch):
    monkeypatch.setattr(entry, "_there", lambda module: False)
    names = entry.queries()
    assert len(names) > 200 and not any(n.startswith("op") for n in names)


def test_missing_modules_are_seen_as_missing():
    assert not entry._there("quarry.nothing") and not entry._there("nothing.at.all") and entry._there("quarry.plans.registry")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
