"""Feature types: declared nested properties over tables, columns, relations and JSON."""

from lodestrata.schema.model import FeatureType, Property
from lodestrata.schema.source_path import SourcePath, Step, parse_path

__all__ = ["FeatureType", "Property", "SourcePath", "Step", "parse_path"]
