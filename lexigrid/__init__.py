"""lexigrid: text-retrieval analytics and training-data operators as Spark DataFrame plans."""
