"""Consensus, family AUC and findings on pages that are unlike enough to pass the gates, against the rules in Python."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from weftline.plans import aggregates, catalog, views

TAGS = "header nav main section article aside footer ul li p div span h1 h2 h3 table tr td button label em b i pre".split()
STYLES = ["btn-x", "btn__y", "btnLarge", "main", "mt-2", "card--big", "gridArea", "p-4", "title", "nav-item"]
PROPERTIES = ["color:#f{0}0", "width:{0}px", "margin:{0}rem", "background:rgb({0},20,90)", "display:grid", "padding:{0}%", "gap:{0}em", "display:flex", "opacity:0.{0}", "height:{0}vh"]
SCRIPT = ["let a{0} = {0};", "if (a === 'x{0}') {{ b(); }}", "document.querySelector('#q{0}');", "fetch('u{0}').then(c => c.json());", "for (const k of d) k++;", "const f = () => ({{a: {0}}});"]


def page(rng, config):
    taste = random.Random(config % 3 * 100 + config)  # what a configuration likes; a family shares some of it
    tags, styles, properties, script = (taste.sample(x, len(x) // 2) for x in (TAGS, STYLES, PROPERTIES, SCRIPT))
    body, open_ = "", []
    for _ in range(rng.randint(15, 30 + 4 * config)):
        tag = rng.choice(tags)
        body += f'<{tag} class="{rng.choice(styles)}">{rng.choice("abc")}'
        open_.append(tag)
        while open_ and rng.random() < 0.5:
            body += f"</{open_.pop()}>"
    css = "".join(f".{rng.choice(styles)}{{{rng.choice(properties).format(rng.randint(1, 9))}}}" for _ in range(rng.randint(4, 12)))
    js = "".join(rng.choice(script).format(rng.randint(1, 4)) for _ in range(rng.randint(3, 9)))
    return f"<html><head><style>{css}</style></head><body>{body}{''.join(f'</{t}>' for t in reversed(open_))}<script>{js}</script></body></html>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(9), tmp_path_factory.mktemp("gates")
    rows = [(i, "u", page(rng, i % 10)) for i in range(250)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(at / "pages.parquet"))
    return str(at)


@pytest.fixture(scope="module")
def merged(spark, folder):
    """The consensus by the rule: each channel's cross medians stretch it to its 1st and 99th percentile."""
    cells, cross = views.dataframe(spark, folder, "cells").collect(), defaultdict(list)
    formal = [c for c in aggregates.CHANNELS if c not in aggregates.DIAGNOSTIC]
    for r in cells:
        if r.kind == "cross" and r.median is not None and r.channel in formal:
            cross[r.batch, r.channel].append(r.median)
    scale = {k: np.quantile(v, [0.01, 0.99]) for k, v in cross.items() if len(v) >= 8}
    scale = {k: (lo, hi) for k, (lo, hi) in scale.items() if hi - lo >= 0.02}
    values = defaultdict(list)
    for r in cells:
        if r.median is not None and (r.batch, r.channel) in scale:
            lo, hi = scale[r.batch, r.channel]
            values[r.batch, r.config_a, r.config_b, r.kind].append(min(max((r.median - lo) / (hi - lo), 0), 1))
    return {k: (sum(v) / len(v), len(v)) for k, v in values.items() if len(v) >= 6}


def family(config):
    return f"f{int(config[1:]) % 3}"


def test_consensus(spark, folder, merged):
    got = {(r.batch, r.config_a, r.config_b, r.kind): (r.merged, r.n_channels) for r in catalog.QUERIES["merged_consensus"](spark, folder).collect()}
    assert got.keys() == merged.keys() and len(got) == 5 * 55
    for k, (v, n) in merged.items():
        assert got[k] == (pytest.approx(v, abs=2e-6), n)
    worst = sorted((round(v, 6), *k[:3]) for k, (v, _) in merged.items() if k[3] == "cross")[:8]
    assert [(r.merged, r.batch, r.config_a, r.config_b) for r in catalog.QUERIES["most_divergent"](spark, folder).collect()] == [(pytest.approx(a, abs=2e-6), *k) for a, *k in worst]


def test_family_auc(spark, folder, merged):
    got = {r.batch: (r.n1, r.n0, r.auc) for r in catalog.QUERIES["family_auc"](spark, folder).collect()}
    assert len(got) == 5
    for batch in got:
        own = {True: [], False: []}
        for (b, x, y, kind), (v, _) in merged.items():
            if b == batch and kind == "cross":
                own[family(x) == family(y)].append(round(v, 9))
        wins = sum((a > b) + (a == b) / 2 for a, b in itertools.product(own[True], own[False]))
        assert got[batch] == (len(own[True]), len(own[False]), pytest.approx(wins / (len(own[True]) * len(own[False])), abs=1e-5))


def test_findings(spark, folder, merged):
    sides, groups = defaultdict(list), defaultdict(list)
    for (_, a, b, kind), (v, _) in merged.items():
        if kind == "self":
            groups["self-consistency", "all"].append(v)
            groups["least self-consistent", a].append(v)
            continue
        same = family(a) == family(b)
        groups["within family" if same else "between families", "all"].append(v)
        if same:
            groups["cohesion", family(a)].append(v)
        for x in (a, b):
            sides[x].append(v)
            if not same:
                groups["reach", family(x)].append(v)
    lowest = lambda rows: sorted(((round(float(np.mean(v)), 6), k) for k, v in rows.items()))[:8]
    want = {("most divergent", k): (len(sides[k]), m) for m, k in lowest({k: v for k, v in sides.items() if len(v) >= 30})}
    for section, least in (("cohesion", 10), ("reach", 100), ("within family", 1), ("between families", 1), ("self-consistency", 1)):
        want |= {k: (len(v), np.mean(v)) for k, v in groups.items() if k[0] == section and len(v) >= least}
    want |= {("least self-consistent", k): (len(groups["least self-consistent", k]), m) for m, k in lowest({k[1]: v for k, v in groups.items() if k[0] == "least self-consistent"})}
    got = {(r.section, r.name): (r.n, r["mean"]) for r in catalog.QUERIES["findings_report"](spark, folder).collect()}
    assert got == {k: (n, pytest.approx(m, abs=3e-6)) for k, (n, m) in want.items()}
    assert {k[0] for k in got} == {"most divergent", "cohesion", "reach", "within family", "between families", "self-consistency", "least self-consistent"}


def test_missing_batches(spark, tmp_path):
    rows = [(k, f"S{k}", k % 5, 5000.0) for k in range(40)] + [(40 + k, f"S{40 + k}", 20 + k, 9000.0) for k in range(2)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.QUERIES["missing_batches"](spark, str(tmp_path)).collect()
    assert {(r.config_id, r.batch_id) for r in got} == {("cfg0", "b0001"), ("cfg1", "b0001")}
