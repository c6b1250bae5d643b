"""peerlens: company similarity search and entity resolution on PySpark DataFrames."""
