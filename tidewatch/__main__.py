"""``python -m tidewatch``: what there is to run."""

if __name__ == "__main__":
    print("usage: import tidewatch in a PySpark session; the queries of __spark_entry__.py show each operator.")
