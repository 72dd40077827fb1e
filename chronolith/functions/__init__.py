"""Column expressions of the text layer behind fuzzy search."""

from chronolith.functions import ids
from chronolith.functions.text import Fold, containment, edit_distance, folded, grams, jaccard, key_length, length_gap, let, normalize

__all__ = ["Fold", "containment", "edit_distance", "folded", "grams", "ids", "jaccard", "key_length", "length_gap", "let", "normalize"]
