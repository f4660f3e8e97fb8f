"""Training-data preparation operators: one module per operator, plain DataFrame in, DataFrame out."""
