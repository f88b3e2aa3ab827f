"""Operators for building training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; Python code on the executors works on whole Arrow batches
with numpy, never a row at a time in the hot path.
"""

from tidemark.llm import blas

blas.one_thread()
