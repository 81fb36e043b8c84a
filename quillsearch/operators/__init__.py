"""Physical operators written as DataFrame plans."""
