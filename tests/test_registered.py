"""The registered modelling queries run the whole of the reference's catalogue."""

from casework.operators import boruta, search
from casework.plans import modelling


class Stop(Exception):
    pass


def called_with(spark, monkeypatch, module, name, query):
    got = {}

    def spy(df, feats, *args, **kw):
        got.update(kw, args=args)
        raise Stop
    monkeypatch.setattr(module, name, spy)
    monkeypatch.setattr(modelling, "_labelled", lambda spark, d: (None, []))
    try:
        query(spark, "")  # the catalogue needs a session
    except Stop:
        pass
    return got


def test_grid_search_runs_the_full_catalogue(spark, monkeypatch):
    specs = called_with(spark, monkeypatch, search, "grid_search", modelling.q_grid_search)["args"][0]
    assert [len(s.param_maps()) for s in specs] == [48, 12]
    assert specs[1].grid["maxIter"] == [100, 200] and specs[0].balanced


def test_boruta_runs_all_rounds_with_the_automatic_tree_count(spark, monkeypatch):
    got = called_with(spark, monkeypatch, boruta, "boruta", modelling.q_boruta)
    assert got["max_iter"] == 100 and got["num_trees"] is None
