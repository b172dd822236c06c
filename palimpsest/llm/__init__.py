"""Operations of a training-data pipeline: filtering, deduplication, counting and packing.

Nothing outside this subpackage imports it.
"""
