"""Credit-risk tables, drift, evaluation and model life cycle as Spark DataFrame operators."""
