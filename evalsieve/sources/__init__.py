"""Reading and writing the file formats of the data sets and results."""
