"""Operations of a training-data pipeline, each one a Spark job over whole tables.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
