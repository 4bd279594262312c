"""Letter-skip search, cross-reference and passage analytics on Spark DataFrames."""

from skipweave.session import make_importable

make_importable()
