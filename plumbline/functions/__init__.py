"""Column expressions and type rules shared by every operator."""
