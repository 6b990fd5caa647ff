"""Reading and writing the household fact."""
