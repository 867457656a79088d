"""Column-in, column-out building blocks; nothing here touches a session."""
