"""Column expressions; nothing here touches a DataFrame."""
