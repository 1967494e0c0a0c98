"""Training-data operators: ten numbered operators and the corpus pipeline's stages.

Nothing outside this subpackage imports it.
"""
