"""Automated relational feature engineering on Spark: related tables in, one lazy feature matrix out."""

from __future__ import annotations

from relfeat import errors, primitives
from relfeat.diagram import SchemaDiagram
from relfeat.plans.features import FeatureList
from relfeat.plans.synthesis import apply_features, deep_feature_synthesis, synthesize
from relfeat.sources.database import Database
from relfeat.sources.schema import Relationship, TableSchema
from relfeat.sources.sink import collect_feature_matrix, convert_table, write_feature_matrix

__all__ = ["Database", "FeatureList", "Relationship", "SchemaDiagram", "TableSchema", "apply_features", "collect_feature_matrix", "convert_table", "deep_feature_synthesis", "errors", "primitives", "synthesize", "write_feature_matrix"]
