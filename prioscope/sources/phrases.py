"""Our own bank of ticket openings: subject, first sentences, typical hours to resolve."""

OPENINGS = [
    ("Storefront is gone", "The payment gateway rejects every card and customers cannot pay. Revenue loss grows each minute!", 1.5),
    ("Cluster alarm", "Server down in two halls, a complete outage for the night shift. All users affected.", 2.0),
    ("Strange sign-ins overnight", "We fear a security breach: credentials compromised on the admin host, maybe ransomware.", 3.0),
    ("Ledger table unreadable", "Database down after the patch and signs of data loss. Please act immediately.", 4.0),
    ("New avatar", "I would like to change picture on my profile, the profile picture is ten years old.", 130.0),
    ("Fewer mails please", "Where are the settings to switch one notification off? It is only a preference.", 95.0),
    ("Idea for the night theme", "A small suggestion and a feature request: darker greys would be nice to have.", 160.0),
    ("Mail with the code is late", "I have a question, the code mail needs four minutes. Is this an issue on your side?", 9.0),
    ("Import stops now and then", "The import is slow and ends with an api error, then a timeout, about one run in five.", 7.0),
    ("\t Whole floor is locked out \n", "We cannot login since eight, the entire team waits. Error 503 on every page.", 3.5),
    ("Button two pixels off", "A minor cosmetic bug, the round button sits too low on small screens.", 190.0),
    ("Invoice wording", "Just an inquiry about the second line of my invoice, I am confused by the tax part.", 70.0),
    ("Numbers vanished", "After the release the figures of March are gone. This looks like data loss in a business critical report.", 5.0),
    ("Charts load for ages", "Performance is degraded, the charts need a minute. It was instant last week.", 22.0),
    ("Other mail address", "Please help me to update email, the old box closes on Friday.", 50.0),
    ("Nothing answers", "Service unavailable everywhere, complete downtime, everyone here is blocked. URGENT URGENT!!!", 1.0),
    ("Contract clock is running", "We are close to an SLA breach and a compliance violation. My manager will escalate.", 2.2),
    ("Letters too small", "Could the letters be one size larger? Thank you for the good work and take this as feedback.", 170.0),
    ("Badge reader offline", "The badge reader is not working and shows connection refused. Some users wait outside.", 6.5),
    ("Files renamed by themselves", "All files on the share carry odd names, an intrusion or a hack is likely. Emergency!", 1.2),
    ("How to print labels", "I am not sure how to print two labels on a sheet, any clarification is welcome.", 35.0),
    ("Orders stuck", "100% of the orders fail and no customers can purchase. We are losing money.", 1.4),
    ("No outage here", "To be clear, this is not a server down case and there was no data breach. The icon is grey.", 140.0),
    ("Still waiting", "This is ridiculous, not the first time, repeatedly reported and still not fixed. The worst service.", 26.0),
    ("Console refuses me", "I cannot access the console, it says unexpected behavior of the token. Authentication looks broken.", 4.4),
    ("Kind words", "No issue at all, I only want to leave feedback: the new menu is lovely.", 210.0),
    ("Throttled", "Our calls are throttled, the result is an error for customers unable to search.", 2.4),
    ("Manual wanted", "May I request the manual of the scanner? Assistance by mail is fine, there is no hurry.", 74.0),
    ("Memory climbs", "Memory climbs until the crash, every two hours, all nodes went down twice today.", 4.1),
    ("New logo", "We have a new logo, the old one is in the settings page. Username change comes later.", 118.0),
    ("Audit finding", "The auditor calls it a regulatory violation. Legal action is possible, financial impact unknown.", 6.2),
    ("<b>Typo</b> on the start page", "<p>There is a <i>minor</i> typo: <br/>teh instead of the.</p>", 99.0),
    ("Checkout is dead", "CHECKOUT IS DEAD. PAYMENT FAILED FOR EVERYONE, all customers affected, no one can purchase!", 1.1),
    ("Wrong currency", "The page shows a wrong result, dollars in place of francs, since the price list update.", 13.0),
    ("Name forgotten", "I forgot my sign-in name, change password did not help, can't recall the mail either.", 47.0),
    ("Migration half done", "The migration stopped, a partial outage of search, intermittent answers, the login issue is back.", 2.8),
    ("Welcome tour", "The welcome tour has eleven steps, a ui improvement would be to cut five.", 105.0),
    ("Certificate ran out", "The certificate ran out, a critical failure of every call. System failure at two sites, come asap.", 1.3),
    ("Hooks are silent", "The hooks don't fire, never mind the emergency lamp, it won't matter before Monday. Feature broken.", 5.5),
    ("Terrible support", "Terrible and unacceptable answers. I will report this, a lawsuit is not excluded. 500 error again.", 30.0),
]

CHANNELS = ["Email", "Chat", "Phone", "Social Media", "Portal"]
TYPES = ["Technical Issue", "Billing", "Feature Request", "Account Management", "Bug Report"]
