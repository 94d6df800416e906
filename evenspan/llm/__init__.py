"""Operations of a training-data pipeline.

One module per operator; ``queries`` binds them to whole tables and ``oracles``
states in SQL what can be stated there.  Nothing outside this folder imports it.
"""
