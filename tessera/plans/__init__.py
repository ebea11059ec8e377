"""Pipelines of operators: captures to tokens, comparisons, exports."""
