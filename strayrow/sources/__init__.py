"""Reading and writing: requests, CSV files, fitted state, predictions."""
