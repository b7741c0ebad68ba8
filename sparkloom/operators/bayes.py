"""Discrete Bayesian networks on observation tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.numeric import log_probability
from sparkloom.operators import counts as C
from sparkloom.operators import factors as fx
from sparkloom.operators import sampling
from sparkloom.operators.network import Network
from sparkloom.session import materialise


RESERVED = {"n", "p", "node", "gid", "weight"}


def _given(variable: str) -> str:
    return f"__given_{variable}"


class BeliefNetwork(Network):
    """A network with fitted conditional tables.

    >>> net = BeliefNetwork("seg", (["seg", "pri"], "st")).fit(observations)
    >>> net.query("st", event={"seg": "BUILDING"})

    Tables are fitted once and stored in the shared folder; every query is a lazy
    DataFrame over them.
    """

    ALGORITHMS = ("exact", "gibbs", "likelihood", "rejection")

    def __init__(self, *structure, prior_count: int | None = None):
        super().__init__(*structure)
        taken = sorted(RESERVED & set(self.nodes))
        if taken:
            raise ValueError(f"rename these variables, the tables use the names: {taken}")
        self.prior_count = prior_count
        self.counts: DataFrame | None = None

    # fitting ---------------------------------------------------------------

    def fit(self, df: DataFrame) -> "BeliefNetwork":
        self.counts = None
        return self.partial_fit(df)

    def partial_fit(self, df: DataFrame) -> "BeliefNetwork":
        """Add a batch. The prior is added with the first batch only."""
        fresh = C.family_counts(df, self)
        if self.counts is not None:
            fresh = C.merge_counts(self.counts, fresh)
        elif self.prior_count:
            fresh = materialise(fresh, "counts")
            fresh = C.merge_counts(fresh, C.prior_counts(fresh, self, self.prior_count))
        self.counts = materialise(fresh, "counts")
        return self

    def with_counts(self, counts: DataFrame) -> "BeliefNetwork":
        """Use a count table that is already stored (see the streaming count merge)."""
        self.counts = counts
        return self

    def save(self, path: str) -> None:
        """Store the counts and the structure under ``path``, in place of what is there.

        The counts are written to a new table first if they were loaded from ``path`` itself.
        """
        spark = self.counts.sparkSession
        self.counts = materialise(self.counts, "counts")
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        rows = [(n, self.parents[n]) for n in sorted(self.nodes)]
        spark.createDataFrame(rows, "node string, parents array<string>").write.mode("overwrite").parquet(f"{path}/structure")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BeliefNetwork":
        rows = spark.read.parquet(f"{path}/structure").collect()  # one per variable
        structure = [(r["parents"], r["node"]) if r["parents"] else r["node"] for r in rows]
        return cls(*structure).with_counts(spark.read.parquet(f"{path}/counts"))

    def cpt(self, node: str) -> DataFrame:
        return C.conditional(self.counts, self, node)

    def cdf(self, node: str) -> DataFrame:
        return C.cumulative(self.counts, self, node)

    def tables(self) -> DataFrame:
        """All conditional tables in long form, named and sorted."""
        variables = sorted(self.nodes)
        parts = []
        for node in self.nodes:
            family = self.family(node)
            parts.append(
                self.cpt(node).select(
                    F.lit(self.factor_name(node)).alias("factor"),
                    *[(F.col(v) if v in family else F.lit(None).cast("string")).alias(v)
                      for v in variables],
                    "p",
                )
            )
        return reduce(lambda a, b: a.unionByName(b), parts).orderBy("factor", *variables)

    # posteriors ------------------------------------------------------------

    def query(
        self,
        *query: str,
        event: Mapping[str, str],
        algorithm: str = "exact",
        rows: DataFrame | None = None,
        id_col: str = "id",
        seed: int = 42,
        n_iterations: int = 100,
        sweeps: int = 2,
        burn_in: int = 0,
    ) -> DataFrame:
        """Posterior of ``query`` given ``event``, columns in name order plus ``p``.

        The sampling algorithms draw one sample (one chain for ``gibbs``) per row of
        ``rows``; without ``rows`` they draw ``n_iterations`` of them. A ``gibbs`` chain
        makes ``sweeps`` passes over the free variables and records those after ``burn_in``.
        """
        if not query:
            raise ValueError("name at least one query variable")
        if set(query) & set(event):
            raise ValueError("a query variable must not be part of the event")
        if algorithm not in self.ALGORITHMS:
            raise ValueError(f"unknown algorithm, use one of {', '.join(self.ALGORITHMS)}")
        if algorithm == "exact":
            answer = self._exact(list(query), event)
        else:
            if rows is None:
                rows = self.counts.sparkSession.range(n_iterations).withColumnRenamed("id", id_col)
            draw = {
                "rejection": sampling.rejection,
                "likelihood": sampling.likelihood_weighting,
                "gibbs": sampling.gibbs,
            }[algorithm]
            more = {"sweeps": sweeps, "burn_in": burn_in} if algorithm == "gibbs" else {}
            answer = draw(self, list(query), event, rows, id_col, seed, **more)
        names = sorted(query)
        return answer.select(*names, "p").orderBy(*names)

    def joint_with(self, keep: set[str], extra: list[DataFrame] = (), event: Mapping[str, str] = {}):
        """Unnormalised factor over ``keep``, with everything irrelevant left out."""
        relevant = set(keep) | self.ancestors(*keep)
        factors = [fx.restrict(self.cpt(n), event) for n in self.nodes if n in relevant]
        factors = fx.eliminate(factors, relevant - set(keep))
        return fx.product_all([*extra, *factors])

    def _exact(self, query: list[str], event: Mapping[str, str]) -> DataFrame:
        joint = self.joint_with({*query, *event}, event=event)
        summed = joint.groupBy(*query).agg(F.sum("p").alias("p"))
        return fx.normalise(summed)

    def full_joint(self, keep_zeros: bool = False) -> DataFrame:
        joint = fx.product_all([self.cpt(n) for n in self.nodes], keep_zeros)
        names = sorted(self.nodes)
        return fx.normalise(joint).select(*names, "p")

    def mass(self) -> DataFrame:
        """One row: total of the product of all tables (below 1 if parents go unseen)."""
        rest = fx.eliminate([self.cpt(n) for n in self.nodes], self.nodes)
        return fx.product_all(rest, keep_zeros=True).agg(F.sum("p").alias("z"))

    # rows ------------------------------------------------------------------

    def predict_proba(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Add the joint probability of each row; unknown label tuples get 0.

        Each table is looked up by an equi-join; the joint itself is never built.
        """
        out = df
        for i, node in enumerate(self.nodes):
            table = self.cpt(node).withColumnRenamed("p", f"__p{i}")
            out = out.join(table, self.family(node), "left")
        value = reduce(
            lambda a, b: a * b,
            [F.coalesce(F.col(f"__p{i}"), F.lit(0.0)) for i in range(len(self.nodes))],
        )
        return out.select(*df.columns, (value / self.mass().scalar()).alias(name))

    def predict_log_proba(self, df: DataFrame, name: str = "log_p") -> DataFrame:
        scored = self.predict_proba(df, "__p")
        return scored.select(*df.columns, log_probability(F.col("__p")).alias(name))

    def sample(self, rows: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
        """One ancestral sample per row of ``rows``, columns in name order."""
        drawn = sampling.forward(self, rows, id_col, seed)
        return drawn.select(id_col, *sorted(self.nodes))

    def impute(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """Fill the nulls of each row with the most probable labels given the rest.

        Ties take the smallest label tuple. Each distinct tuple with gaps is solved once, whatever
        it misses, and one join carries the answers to the rows. A row whose known labels never
        occur together in the model has no most probable completion and keeps its nulls.
        """
        variables = sorted(self.nodes)
        rows = df.select(id_col, *[F.col(v).cast("string").alias(v) for v in variables])
        gaps = rows.where(F.greatest(*[F.col(v).isNull() for v in variables], F.lit(False))).select(*variables).distinct()
        # stored, so that its size decides how it is joined
        best = materialise(self._completions(gaps), "completions")
        same = [F.col(f"r.{v}").eqNullSafe(F.col(f"b.{_given(v)}")) for v in variables]
        filled = [F.coalesce(f"r.{v}", f"b.{v}").alias(v) for v in variables]
        return rows.alias("r").join(best.alias("b"), same, "left").select(F.col(f"r.{id_col}"), *filled)

    def _completions(self, gaps: DataFrame) -> DataFrame:
        """The most probable labels of all variables for each tuple, next to the tuple as it was given.

        Variables are bound in topological order. A table holds each of its rows twice, once under
        its label and once under null, so known and missing labels meet it in the same equi-join.
        As soon as all tables that mention a variable are multiplied in, the best of its labels
        is kept for each choice of the others.
        """
        variables = sorted(self.nodes)
        given = [_given(v) for v in variables]
        state = gaps.select(*[F.col(v).alias(_given(v)) for v in variables], F.lit(1.0).alias("p"))
        bound = []
        for place, node in enumerate(self.nodes):
            table = fx.drop_zeros(self.cpt(node)).withColumnRenamed("p", "__q")
            keys = F.explode(F.array(F.col(node), F.lit(None))).alias(_given(node))
            table = table.select("*", keys).alias("t")
            on = [F.col(f"s.{v}") == F.col(f"t.{v}") for v in self.parents[node]]
            on.append(F.col(f"s.{_given(node)}").eqNullSafe(F.col(f"t.{_given(node)}")))
            state = state.alias("s").join(table, on).select(
                *[f"s.{c}" for c in [*given, *bound]], f"t.{node}", (F.col("s.p") * F.col("t.__q")).alias("p"))
            bound.append(node)
            later = self.nodes[place + 1:]
            # parents that no later table mentions; at the end, all
            live = [v for v in bound if any(v in self.parents[n] for n in later)]
            done = sorted(set(bound) - set(live))
            if not later or set(done) & {*self.parents[node], node}:
                # min over (-p, labels): highest probability, then smallest labels
                best = F.min(F.struct((-F.col("p")).alias("neg"), *done)).alias("best")
                state = state.groupBy(*given, *live).agg(best).select(
                    *given, *live, *[f"best.{v}" for v in done], (-F.col("best.neg")).alias("p"))
                bound = [*live, *done]
        return state.select(*given, *variables)
