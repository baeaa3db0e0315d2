"""Example models: small published Bayesian networks and parameterised factor graphs."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.operators.factors import Factor, Model, cpt, dense, filled, sparse

YES_NO, TRUE_FALSE = ("yes", "no"), ("True", "False")

# The published tables of the networks, child first, in natural order (the last variable fastest).
NETWORKS: dict[str, tuple[dict[str, tuple], list[tuple[tuple[str, ...], tuple[float, ...]]]]] = {
    "sprinkler": (
        {"rain": ("not raining", "raining"), "sprinkler": ("off", "on"), "grass": ("dry", "damp", "wet")},
        [
            (("grass", "rain", "sprinkler"), (0.90, 0.01, 0.02, 0.01, 0.09, 0.01, 0.08, 0.04, 0.01, 0.98, 0.90, 0.95)),
            (("rain",), (0.8, 0.2)),
            (("sprinkler",), (0.9, 0.1)),
        ],
    ),
    "student": (
        {"difficult": ("Yes", "No"), "intelligent": ("Yes", "No"), "grade": ("1", "2", "3"), "sat": ("High", "Low"), "letter": ("Yes", "No")},
        [
            (("difficult",), (0.6, 0.4)),
            (("intelligent",), (0.7, 0.3)),
            (("grade", "difficult", "intelligent"), (0.3, 0.05, 0.9, 0.5, 0.4, 0.25, 0.08, 0.3, 0.3, 0.7, 0.02, 0.2)),
            (("sat", "intelligent"), (0.95, 0.2, 0.05, 0.8)),
            (("letter", "grade"), (0.1, 0.4, 0.99, 0.9, 0.6, 0.01)),
        ],
    ),
    "rain": (
        {"Winter": (True, False), "Sprinkler": (True, False), "Rain": (True, False), "Wet Grass": (True, False), "Slippery Road": (True, False)},
        [
            (("Winter",), (0.6, 0.4)),
            (("Sprinkler", "Winter"), (0.2, 0.75, 0.8, 0.25)),
            (("Rain", "Winter"), (0.8, 0.1, 0.2, 0.9)),
            (("Wet Grass", "Sprinkler", "Rain"), (0.95, 0.9, 0.8, 0, 0.05, 0.1, 0.2, 1)),
            (("Slippery Road", "Rain"), (0.7, 0, 0.3, 1)),
        ],
    ),
    "asia": (
        {n: YES_NO for n in ("asia", "tub", "smoke", "lung", "bronc", "either", "xray", "dysp")},
        [
            (("asia",), (0.01, 0.99)),
            (("tub", "asia"), (0.05, 0.01, 0.95, 0.99)),
            (("smoke",), (0.5, 0.5)),
            (("lung", "smoke"), (0.1, 0.01, 0.9, 0.99)),
            (("bronc", "smoke"), (0.6, 0.3, 0.4, 0.7)),
            (("either", "lung", "tub"), (1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
            (("xray", "either"), (0.98, 0.05, 0.02, 0.95)),
            (("dysp", "bronc", "either"), (0.9, 0.8, 0.7, 0.1, 0.1, 0.2, 0.3, 0.9)),
        ],
    ),
    "cancer": (
        {"pollution": ("low", "high"), "smoker": TRUE_FALSE, "cancer": TRUE_FALSE, "xray": ("positive", "negative"), "dyspnoea": TRUE_FALSE},
        [
            (("pollution",), (0.9, 0.1)),
            (("smoker",), (0.3, 0.7)),
            (("cancer", "pollution", "smoker"), (0.03, 0.001, 0.05, 0.02, 0.97, 0.999, 0.95, 0.98)),
            (("xray", "cancer"), (0.9, 0.2, 0.1, 0.8)),
            (("dyspnoea", "cancer"), (0.65, 0.3, 0.35, 0.7)),
        ],
    ),
    "earthquake": (
        {n: TRUE_FALSE for n in ("Burglary", "Earthquake", "Alarm", "JohnCalls", "MaryCalls")},
        [
            (("Burglary",), (0.01, 0.99)),
            (("Earthquake",), (0.02, 0.98)),
            (("Alarm", "Burglary", "Earthquake"), (0.95, 0.94, 0.29, 0.001, 0.05, 0.06, 0.71, 0.999)),
            (("JohnCalls", "Alarm"), (0.9, 0.05, 0.1, 0.95)),
            (("MaryCalls", "Alarm"), (0.7, 0.01, 0.3, 0.99)),
        ],
    ),
    "survey": (
        {"A": ("young", "adult", "old"), "S": ("M", "F"), "E": ("high", "uni"), "O": ("emp", "self"), "R": ("small", "big"), "T": ("car", "train", "other")},
        [
            (("A",), (0.3, 0.5, 0.2)),
            (("S",), (0.6, 0.4)),
            (("E", "A", "S"), (0.75, 0.64, 0.72, 0.7, 0.88, 0.9, 0.25, 0.36, 0.28, 0.3, 0.12, 0.1)),
            (("O", "E"), (0.96, 0.92, 0.04, 0.08)),
            (("R", "E"), (0.25, 0.2, 0.75, 0.8)),
            (("T", "O", "R"), (0.48, 0.58, 0.56, 0.7, 0.42, 0.24, 0.36, 0.21, 0.1, 0.18, 0.08, 0.09)),
        ],
    ),
}


def network(spark: SparkSession, name: str) -> Model:
    """One of the published networks."""
    states, tables = NETWORKS[name]
    v = {n: Variable(n, s) for n, s in states.items()}
    return Model(tuple(v.values()), tuple(dense(spark, [v[n] for n in scope], values) for scope, values in tables))


def from_scopes(spark: SparkSession, sizes: dict[str, int], scopes: Iterable[tuple[str, ...]], seed: int = 1, weight: Callable | None = None) -> Model:
    """A factor graph with random weights in (0, 1], the same for the same seed."""
    v = {n: Variable(n, tuple(range(k))) for n, k in sizes.items()}
    found = []
    for k, scope in enumerate(scopes):
        mixed = F.xxhash64(F.lit(seed), F.lit(k), *(F.col(n) for n in scope))
        w = (F.pmod(mixed, F.lit(1_000_003)) + 1) / F.lit(1_000_003.0) if weight is None else weight(k)
        found.append(filled(spark, [v[n] for n in scope], w))
    return Model(tuple(v.values()), tuple(found))


def chain(spark: SparkSession, n: int = 20, states: int = 4, seed: int = 1) -> Model:
    """``n`` variables, each sharing a factor with the next."""
    return from_scopes(spark, {f"x{k}": states for k in range(n)}, [(f"x{k}", f"x{k + 1}") for k in range(n - 1)], seed)


def loop(spark: SparkSession, n: int = 8, states: int = 3, seed: int = 1) -> Model:
    """A chain whose ends meet."""
    return from_scopes(spark, {f"x{k}": states for k in range(n)}, [(f"x{k}", f"x{(k + 1) % n}") for k in range(n)], seed)


def clique(spark: SparkSession, n: int = 5, states: int = 2, pairs: bool = True, seed: int = 1) -> Model:
    """Factors between all pairs, or one over all variables."""
    names = [f"x{k}" for k in range(n)]
    scopes = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]] if pairs else [tuple(names)]
    return from_scopes(spark, dict.fromkeys(names, states), scopes, seed)


def star(spark: SparkSession, arms: int = 3, length: int = 2, states: int = 2, seed: int = 1) -> Model:
    """Chains that meet in one variable."""
    sizes, scopes = {"x": states}, []
    for a in range(arms):
        before = "x"
        for k in range(length):
            name = f"x{a}_{k}"
            sizes[name] = states
            scopes.append((before, name))
            before = name
    return from_scopes(spark, sizes, scopes, seed)


def rectangle(spark: SparkSession, rows: int = 3, columns: int = 3, states: int = 2, seed: int = 1) -> Model:
    """A grid with factors between neighbours."""
    sizes = {f"x{r}_{c}": states for r in range(rows) for c in range(columns)}
    scopes = [(f"x{r}_{c}", f"x{r}_{c + 1}") for r in range(rows) for c in range(columns - 1)]
    scopes += [(f"x{r}_{c}", f"x{r + 1}_{c}") for r in range(rows - 1) for c in range(columns)]
    return from_scopes(spark, sizes, scopes, seed)


def run_of_triples(spark: SparkSession, n: int = 6, states: int = 2, seed: int = 1) -> Model:
    """Factors over every three variables in a row."""
    return from_scopes(spark, {f"x{k}": states for k in range(n)}, [(f"x{k}", f"x{k + 1}", f"x{k + 2}") for k in range(n - 2)], seed)


def cnf(spark: SparkSession, n: int = 8, clauses: int = 12, shortest: int = 2, longest: int = 3, seed: int = 1) -> Model:
    """Binary variables and random clauses: its weight counts the satisfying instances."""
    from marginalia.operators.factors import clause

    rng = random.Random(seed)
    v = [Variable(f"x{k}", (0, 1)) for k in range(n)]
    found = []
    for _ in range(clauses):
        some = rng.sample(v, rng.randint(shortest, longest))
        found.append(clause(spark, some, [rng.randrange(2) for _ in some]))
    return Model(tuple(v), tuple(found))


# The edges of small factor graphs, between single letters.
GRAPHS = {
    "diamond_square": "ac ae bc bd cd ce df dh ef eg fg fh",
    "triangle_square": "ab ac bc bd ce de df ef",
    "truss": "ab ac bc bd cd ce de",
}


def graph(spark: SparkSession, name: str, states: int = 2, unaries: bool = True, seed: int = 1) -> Model:
    """One of the small graphs, with a factor for each edge and, if wanted, each variable."""
    edges = [tuple(e) for e in GRAPHS[name].split()]
    names = sorted({v for e in edges for v in e})
    return from_scopes(spark, dict.fromkeys(names, states), edges + [(v,) for v in names] * unaries, seed)


def bow_tie(spark: SparkSession, states: int = 2, seed: int = 1) -> Model:
    """Two factors of three variables that share one."""
    return from_scopes(spark, {f"x{k}": states for k in range(1, 6)}, [("x1", "x2", "x3"), ("x1", "x4", "x5")], seed)


def empty() -> Model:
    """No variables and no factors."""
    return Model((), ())


def random_network(spark: SparkSession, n: int = 37, most_parents: int = 2, states: int = 3, seed: int = 1) -> Model:
    """A Bayesian network of ``n`` variables whose parents are among the four before."""
    rng = random.Random(seed)
    v, found = [], []
    for k in range(n):
        v.append(Variable(f"n{k}", tuple(range(states))))
        parents = sorted(rng.sample(range(max(0, k - 4), k), min(k, rng.randint(1, most_parents))))
        family = [v[k], *(v[p] for p in parents)]
        mixed = F.xxhash64(F.lit(seed), F.lit(k), *(F.col(x.name) for x in family))
        found.append(cpt(filled(spark, family, (F.pmod(mixed, F.lit(997)) + 1) / F.lit(997.0))))
    return Model(tuple(v), tuple(found))


def stress(spark: SparkSession) -> Model:
    """Odd names and states, and most kinds of factors, some over the same variables."""
    a, b, c = Variable("a=b, c", (2.5, None, "x;y", True)), Variable("größe %", (False, True)), Variable("kind", (7, "7", 7.0))
    return Model((a, b, c), (dense(spark, [a, b], range(8)), sparse(spark, [b, c], {(0, 1): 0.5, (1, 2): 2.0}), cpt(dense(spark, [c, a], range(12))), Factor((c,), filled(spark, [c], F.lit(1.0)).table)))
