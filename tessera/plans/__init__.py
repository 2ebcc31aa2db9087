"""Planning of build targets and response space."""
