"""Table operators: DataFrame in, DataFrame out, used with ``df.transform``."""
