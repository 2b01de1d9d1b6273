"""End-to-end jobs: export to analysis tables, draws to effect report, ratings to scale report."""

from .effect_report import EffectReport, covariate_report, effect_report
from .scale_report import ScaleReport, scale_report
from .study_tables import StudySpec, StudyTables, answered_block, panel_table, study_tables

__all__ = ["EffectReport", "ScaleReport", "StudySpec", "StudyTables", "answered_block", "covariate_report",
           "effect_report", "panel_table", "scale_report", "study_tables"]
