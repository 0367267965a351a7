"""Where tables come from and go to: the lake, remote services and configuration."""
