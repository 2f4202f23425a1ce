"""Import every query module; the registry fills as they load."""

from hourgrain.plans.registry import ORACLES, QUERIES

from hourgrain.plans import q_columns, q_sources, q_quality, q_spectra, q_align, q_scores, q_models, q_studies  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
