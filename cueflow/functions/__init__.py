"""Column functions: time stamps, text cleaning and display values."""
