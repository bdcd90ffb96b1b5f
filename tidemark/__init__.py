"""tidemark: a Spark-first real-time warehouse engine.

Layer functions are plain ``DataFrame -> DataFrame``; the subpackages hold
sources, operators, functions, whole-layer plans and the streaming twins.
"""
