"""Sources: the driver's tables as catalog entities, and the feeds' wire formats."""
