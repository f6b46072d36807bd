"""Book-catalogue quality analytics on PySpark: DataFrame in, DataFrame out."""
