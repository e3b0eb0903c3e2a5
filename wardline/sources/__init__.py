"""Where messages come from and where verdicts go."""
