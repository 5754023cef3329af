"""Column expressions and naming rules shared by the operators."""
