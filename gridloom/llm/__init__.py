"""Operations on training corpora: deduplication, scoring, filtering, formatting and packing.

Nothing else in the library imports this subpackage.
"""
