"""Operations of a training-data pipeline, each one usable on its own.

Nothing outside this subpackage imports it.
"""
