"""Small column functions of the engine, gathered for import."""

from evtide.operators.etl import json_slice, plain_name, token_estimate
from evtide.operators.retrieval import cosine, dot, normalised, tokens
from evtide.operators.scoring import lenient_date, near
from evtide.plans.templates import bucket_label, role_name, within
from evtide.runtime import clean_key, stand_in, stripped

__all__ = ["bucket_label", "clean_key", "cosine", "dot", "json_slice", "lenient_date", "near", "normalised", "plain_name", "role_name", "stand_in", "stripped", "token_estimate", "tokens", "within"]
