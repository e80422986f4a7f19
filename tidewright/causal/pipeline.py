"""The whole study in stages: windows, scores, matches, estimates. Each stage holds lazy frames."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators.materialize import cut
from . import cohort, matching, models, reports
from .config import Study


@dataclass
class Raw:
    study: Study
    subjects: DataFrame
    facts: dict[str, DataFrame]

    def windowed(self) -> Windowed:
        wide = cut(cohort.compute_windows(self.study.validated(), self.subjects, self.facts))
        return Windowed(self.study, self.subjects, self.facts, wide)


@dataclass
class Windowed:
    study: Study
    subjects: DataFrame
    facts: dict[str, DataFrame]
    wide: DataFrame

    def scored(self) -> Scored:
        """Universe, input gates, propensity and its bins; subjects outside the universe get no score."""
        s = self.study
        rows = self.subjects.join(self.wide, s.subject)
        inside = cohort.signature_universe(rows, s.signature, "reached") if s.signature else rows
        inside = cut(inside)
        cohort.require_inputs(s, inside, "reached")
        features = [*models.one_hot(inside, s.categorical), *models.standardised(inside, s.numeric)]
        model = models.fit_logistic(inside, "reached", features)
        scored = inside.withColumn("propensity_score", model.probability()).withColumn("in_universe", F.lit(1))
        return Scored(s, self, cut(models.attach_bins(scored, "propensity_score", s.subject, "propensity_decile", s.bins, s.binning)), model)


@dataclass
class Scored:
    study: Study
    before: Windowed
    rows: DataFrame
    model: models.Logistic

    def matched(self) -> Matched:
        """Pairs under the study's gates, relaxed first where the study says so."""
        study = matching.autotuned(self.study, self.rows)
        matches, sizes = matching.match_controls(study, self.rows)
        matches = cut(matches)
        if matches.isEmpty():
            raise ConfigError("no test found a control; the gates may be too strict")
        return Matched(study, self, matches, sizes)


@dataclass
class Matched:
    study: Study
    before: Scored
    matches: DataFrame
    sizes: DataFrame

    def pairs(self) -> DataFrame:
        return matching.pair_rows(self.study, self.matches, self.before.rows)

    def estimated(self) -> Estimated:
        """ANCOVA of every outcome, once the placebo check holds."""
        s, pairs = self.study, cut(self.pairs())
        checks = matching.placebo(pairs, s.placebo, s.placebo_max) if s.placebo else None
        if checks is not None and (failed := checks.where(~F.col("passed")).collect()):
            raise ConfigError(f"groups differ before treatment: {[r.asDict() for r in failed]}")
        fits = [models.ancova(pairs, o, "treatment", f"{matching.measure_of(o)}_PRE12M", s.covariates, s.categorical) for o in s.outcomes]
        return Estimated(s, self, fits)


@dataclass
class Estimated:
    study: Study
    before: Matched
    fits: list[models.Fit]

    def export(self, folder: str, first_month: tuple[int, int] = (2024, 1), configs: dict[str, str] | None = None) -> None:
        """All tables, the summary, the fits and the configuration; ``configs`` maps a file's name to its text, of which a copy is kept."""
        s, matched = self.study, self.before
        rows, wide = matched.before.rows, matched.before.before.wide
        who = matched.before.before.subjects
        groups = reports.group_labels(matched.matches, s.subject)
        planned = next((c for c in ("planned_reach_month", "reach_month") if c in who.columns), None)
        counts = reports.waterfall(rows, matched.matches, s.subject).first().asDict()
        frames = {
            "subjects": rows.select(*[c for c in rows.columns if not c.startswith(tuple(f"{m}_" for m in s.measures))]),
            "windows": wide, "matches": matched.matches,
            "timeseries": reports.time_series(matched.before.before.facts, groups, s.subject, s.month),
        }
        if planned:
            frames["target_list"] = reports.target_list(who, s.subject, planned, *first_month, tuple(c for c in s.categorical if c in who.columns))
        reports.export(folder, frames, counts, asdict(s), self.fits, configs)
