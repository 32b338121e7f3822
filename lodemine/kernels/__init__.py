"""Array code for images: NumPy only, called from Arrow and pandas UDFs."""
