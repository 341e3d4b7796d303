"""tabprobe.functions"""
